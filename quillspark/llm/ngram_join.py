"""N-gram Jaccard self-join with a token-group matrix.

A document's set is its distinct word shingles, as 64-bit hashes with a seed of
the run; documents of equal sets are one node, named by 128 bits of the set. The first documents of
all nodes take part in what follows, so copies cost nothing more.

Similar nodes are put in groups of bounded size: nodes that share the least
token of one of three hash orders. Inside a group sets are compared exactly.
That finds nearly all links; connected nodes are one component from then on.

The rest is found the exact way. Two sets that reach the similarity share a
token among the first tokens of both, in any order of tokens that is the same
for all. Here tokens that seem to be in one set alone come first, so that most
sets meet no other, and frequent tokens come last. Only tokens that nodes of
different components have there are looked at. A row of the matrix is the union
of the tokens of a group of such nodes; a query meets each group with which it
shares a first token, its overlap with the union bounds its overlap with any
member, and only groups that reach the bound are opened. The first token that
two similar sets share stands early enough in both for the rest to hold their
overlap; a query meets a group only if that can be so for a member. Of a token's
nodes those of its largest component don't ask.

Links are the pairs with percent * |union| <= 100 * |intersection|. Only which
nodes are connected is kept, so a group of copies is never expanded to pairs.

Results by case: texts without words have an empty set and are linked with
nothing; fewer words than a shingle are one shingle; null ids take part and get
the smallest id of their component, null if it has none; repeated ids have a
row for each input row; an empty table gives no rows; a text of any length is
one set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import connected, tasks

#: Sets of a group and their tokens, about, at most; queries of a group that one task answers.
GROUP, GROUP_TOKENS, ASKING = 256, 1 << 21, 1024
#: Hash orders whose least tokens make groups.
ORDERS = 3
#: Sets that share a token from which it counts as frequent.
FREQUENT = 32
#: One in COUNTED tokens, by hash, is counted everywhere; others where a chunk has them in COMMON sets.
COUNTED, COMMON = np.uint64(4), 4
#: Frequent tokens that are put last at most, and bits of the filter of repeated ones; the order affects speed alone, never the links.
RANKED, FILTER_BITS = 1 << 18, 1 << 28
_U = np.uint64


class Order:
    """The order of tokens: rank 0 those that seem to be in one set alone, 1 unknown ones, 2 repeated ones, then frequent ones by number."""

    def __init__(self, n: int, rows: list):
        self.n = np.uint64(n)
        self.mask = np.zeros(n, np.uint64)
        self.offset = np.zeros(n, np.int64)
        bits, at = [np.zeros(1, np.uint8)], 1
        for row in rows:
            self.mask[row.bucket], self.offset[row.bucket] = len(row.bits) * 8 - 1, at
            bits.append(np.frombuffer(row.bits, np.uint8))
            at += len(row.bits)
        self.bits = np.concatenate(bits)
        token, sets = (np.frombuffer(b"".join(r[c] for r in rows), np.uint64) for c in ("tokens", "sets"))
        order = np.argsort(token)
        self.tokens, self.sets = token[order], sets[order].astype(np.int64)

    def rank(self, tokens: np.ndarray) -> np.ndarray:
        out = np.ones(len(tokens), np.int64)
        counted = np.flatnonzero(tokens % COUNTED == 0)
        some = tokens[counted]
        bucket = ((some >> np.uint64(32)) * self.n >> np.uint64(32)).astype(np.int64)
        repeated = self.mask[bucket] > 0
        for place in filter_places(some, self.mask[bucket]):
            byte = self.bits[self.offset[bucket] + (place >> np.uint64(3)).astype(np.int64)]
            repeated &= (byte >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        out[counted] = np.where(repeated, 2, 0)
        known = np.flatnonzero(self.frequent(tokens))
        out[known] = 2 + self.sets[np.searchsorted(self.tokens, tokens[known])]
        return out

    def frequent(self, tokens: np.ndarray) -> np.ndarray:
        """Whether the tokens are among the numbered ones."""
        if not len(self.tokens):
            return np.zeros(len(tokens), bool)
        return self.tokens[np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)] == tokens


def filter_places(tokens: np.ndarray, mask) -> list[np.ndarray]:
    one, two = C.mix(tokens), C.mix(~tokens) | np.uint64(1)
    return [(one + np.uint64(i) * two) & mask for i in range(4)]


class Sets:
    """The token sets of a chunk: tokens of document i are tokens[first[i]:first[i + 1]], distinct and ascending."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, words: int, seed: int = 0):
        start, end, first = C.word_spans(data, bounds)
        hashes, doc = C.shingles(C.word_hashes(data, start, end, fold=True, seed=seed), first, words)
        order = np.lexsort((hashes, doc))
        hashes, doc = hashes[order], doc[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
        self.tokens, self.doc = hashes[new], doc[new]
        self.first = np.searchsorted(self.doc, np.arange(len(bounds)))
        self.n = np.diff(self.first)
        self.full = np.flatnonzero(self.n > 0)
        total = np.concatenate([np.zeros(1, _U), np.cumsum(C.mix(self.tokens + _U(1)))])
        other = np.concatenate([np.zeros(1, _U), np.cumsum(C.mix(self.tokens ^ _U(0x6A09E667F3BCC909)))])
        of = lambda x: x[self.first[1:]] - x[self.first[:-1]]
        #: 128 bits of each set
        self.node = np.stack([C.mix(of(total)), C.mix(of(other) ^ self.n.astype(_U) << _U(40))], 1)
        _, once = np.unique(self.node[self.full, 0], return_index=True)
        self.once = self.full[np.sort(once)]

    def leads(self) -> np.ndarray:
        """The least token of each hash order, a column each; 0 for an empty set."""
        out = np.zeros((len(self.n), ORDERS), _U)
        for k in range(ORDERS if len(self.full) else 0):
            out[self.full, k] = np.minimum.reduceat(C.mix(self.tokens * _U(2 * k + 1) + _U(k)), self.first[:-1][self.full])
        return out

    def prefixes(self, percent: int, order: Order) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(token, document, place) of the first tokens of each distinct set: as many as two similar sets can't both miss."""
        at = C.ragged(self.first[self.once], self.n[self.once])
        return first_tokens(self.tokens[at], np.repeat(self.once, self.n[self.once]), percent, order)

    def blobs(self, at: np.ndarray) -> pa.Array:
        return pa.array([C.blob(self.tokens[self.first[i] : self.first[i + 1]]) for i in at], pa.binary())


def names(node: np.ndarray, mask: np.ndarray | None = None) -> pa.Array:
    """Nodes as binary values of 16 bytes; null where mask is set."""
    out = pa.Array.from_buffers(pa.binary(16), len(node), [None, pa.py_buffer(node.astype(">u8").tobytes())]).cast(pa.binary())
    return out if mask is None else pa.compute.if_else(pa.array(~mask), out, pa.scalar(None, pa.binary()))


def numbers(names: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(names.to_pylist()), ">u8").reshape(-1, 2).astype(_U)


def first_tokens(tokens: np.ndarray, owner: np.ndarray, percent: int, order: Order) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, owner, place in its set's order) of the first tokens."""
    by = np.lexsort((tokens, order.rank(tokens), owner))
    tokens, owner = tokens[by], owner[by]
    head = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
    n = np.diff(np.append(head, len(owner)))
    keep = n - (percent * n + 99) // 100 + 1
    at = C.ragged(head, keep)
    return tokens[at], owner[at], at - np.repeat(head, keep)


def reach(n: np.ndarray, place: np.ndarray, percent: int) -> np.ndarray:
    """percent times the largest size of a similar set with which a set of n shares its token at `place` first.

    Similar sets of n and m have at least percent * (n + m) / (100 + percent) tokens in common, and of them
    a set of n has no more than n - place.
    """
    return 100 * n - (100 + percent) * place


def _members(words: int, seed: int):
    """The columns besides text, the node (null for an empty set), its size and its least tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, bounds in C.chunks(batches):
            s = Sets(data, bounds, words, seed)
            kept = [c for c in rows.schema.names if c != "text"]
            leads = s.leads().view(np.int64)
            yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in kept], names(s.node, s.n == 0), pa.array(s.n), *[pa.array(leads[:, k]) for k in range(ORDERS)]], [*kept, "node", "n", *LEADS])

    return run


LEADS = [f"lead{k}" for k in range(ORDERS)]
_BLOBS = pa.schema([("bucket", pa.int32()), ("tokens", pa.binary()), ("nodes", pa.binary()), ("sizes", pa.binary()), ("places", pa.binary())])
BLOBS = "bucket int, tokens binary, nodes binary, sizes binary, places binary"


def _blobs(n: int, deal: np.ndarray, token: np.ndarray, node: np.ndarray | None, size: np.ndarray, place: np.ndarray | None = None) -> pa.RecordBatch:
    order, cut = C.split_by(deal, n)
    out: dict[str, list] = {name: [] for name in _BLOBS.names}
    for b in range(n):
        own = order[cut[b] : cut[b + 1]]
        if len(own):
            values = (token, node, size.astype(np.uint32), None if place is None else place.astype(np.uint32))
            for name, x in zip(_BLOBS.names, (b, *[b"" if x is None else C.blob(x[own]) for x in values]), strict=True):
                out[name].append(x)
    return C.record(_BLOBS, out)


def _counted_blobs(words: int, seed: int, n: int):
    """Counted tokens by hash bucket, with the number of sets of the chunk that have them and 8 bits of one set's name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, bounds in C.chunks(batches):
            s = Sets(data, bounds, words, seed)
            at = C.ragged(s.first[s.once], s.n[s.once])
            token, first, size = np.unique(s.tokens[at], return_index=True, return_counts=True)
            node = s.node[s.doc[at[first]], 0] & _U(255)
            use = (token % COUNTED == 0) | (size >= COMMON)
            yield _blobs(n, token[use], token[use], None, (size[use].astype(_U) << _U(8)) | node[use])

    return run


def _prefix_blobs(words: int, seed: int, percent: int, n: int, order):
    """First tokens by hash bucket, frequent ones dealt over all buckets, with their sets and their sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, bounds in C.chunks(batches):
            s = Sets(data, bounds, words, seed)
            token, doc, place = s.prefixes(percent, order.value)
            deal = np.where(order.value.frequent(token), C.mix(token ^ s.node[doc, 0]), token)
            yield _blobs(n, deal, token, s.node[doc], s.n[doc], place)

    return run


def _joined(table: pa.Table, column: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x for part in table.column(column).chunks for x in part.to_pylist()), kind)


def _survey(n: int):
    """Of a bucket: a filter of the counted tokens that several sets have, and the most frequent tokens."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        token, value = _joined(table, "tokens", np.uint64), _joined(table, "sizes", np.uint32)
        order = np.argsort(token, kind="stable")
        token, size, node = token[order], (value[order] >> 8).astype(np.int64), value[order] & 255
        head = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        token, count = token[head], np.add.reduceat(size, head)
        # copies of one set in several chunks don't make its tokens repeated
        several = (np.maximum.reduceat(size, head) > 1) | (np.maximum.reduceat(node, head) != np.minimum.reduceat(node, head))
        keys = token[several & (token % COUNTED == 0)]
        size = 1 << int(np.ceil(np.log2(max(64, 12 * len(keys)))))
        while size > max(64, FILTER_BITS // n):
            size //= 2
        bits = np.zeros(size // 8, np.uint8)
        for place in filter_places(keys, np.uint64(size - 1)):
            np.bitwise_or.at(bits, (place >> np.uint64(3)).astype(np.int64), (1 << (place & np.uint64(7))).astype(np.uint8))
        top = np.flatnonzero(count > FREQUENT)
        top = top[np.lexsort((token[top], -count[top]))][: max(1, RANKED // n)]
        C.release()
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "bits": pa.array([C.blob(bits)], pa.binary()), "tokens": pa.array([C.blob(token[top])], pa.binary()), "sets": pa.array([C.blob(count[top].astype(np.uint64))], pa.binary())})

    return run


def _shared(percent: int, order):
    """(token, node, n, reach) of the nodes that share a first token with another one whose size allows the similarity.

    In order of size, the smaller of two similar nodes has their first common
    token early: it reaches its own size; so a node counts if an early one before it, or it before the
    next one, is large enough. Frequent tokens aren't together here and all count.
    """

    def run(table: pa.Table) -> pa.Table:
        token, node = _joined(table, "tokens", _U), _joined(table, "nodes", _U).reshape(-1, 2)
        size, far = (_joined(table, c, np.uint32).astype(np.int64) for c in ("sizes", "places"))
        far = reach(size, far, percent)
        by = np.lexsort((node[:, 1], node[:, 0], size, token))
        token, node, size, far = token[by], node[by], size[by], far[by]
        again = np.zeros(len(token), bool)
        again[1:] = (token[1:] == token[:-1]) & (node[1:] == node[:-1]).all(1)
        token, node, size, far = token[~again], node[~again], size[~again], far[~again]
        early = far >= percent * size
        head = np.concatenate([[True], token[1:] != token[:-1]])[: len(token)]
        place = np.arange(len(token))
        last = np.maximum.accumulate(np.where(early, place, -1))[:-1]  # the largest early node so far
        of_token = np.maximum.accumulate(np.where(head, place, 0))[:-1]
        near = ~head[1:] & (last >= of_token) & (100 * size[last] >= percent * size[1:])
        use = order.value.frequent(token)
        use[1:] |= near
        use[:-1] |= near
        C.release()
        return pa.table({"token": pa.array(token[use].view(np.int64)), "node": names(node[use]), "n": pa.array(size[use]), "reach": pa.array(far[use])})

    return run


def _lead_keys(lead: np.ndarray, k: int | np.ndarray, level: int | np.ndarray) -> np.ndarray:
    return C.mix(lead ^ C.mix(np.asarray(k).astype(_U) * _U(257) + np.asarray(level).astype(_U)))


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of a filter: level 0 for each shared lead, and each level that its nodes' number has."""
    for batch in batches:
        k, lead, level = (batch.column(c).to_numpy() for c in ("k", "lead", "level"))
        at = np.repeat(np.arange(len(k)), level + 1)
        keys = _lead_keys(lead.view(_U)[at], k[at], C.ragged(np.zeros(len(k), np.int64), level + 1))
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], ["key"])


def _grouped_sets(words: int, seed: int, rows, leads):
    """The sets of wanted rows, once for each of their shared leads; of many nodes that share it, by 2 ** level pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, bounds in C.chunks(batches):
            s = Sets(data, bounds, words, seed)
            wanted = rows.value.test(batch.column("row").to_numpy().view(_U)) & (s.n > 0)
            lead = s.leads()
            own, gid = [], []
            for k in range(ORDERS):
                at = np.flatnonzero(wanted)
                at = at[leads.value.test(_lead_keys(lead[at, k], k, 0))]
                level, now = np.zeros(len(at), np.int64), np.arange(len(at))
                while len(now):
                    now = now[leads.value.test(_lead_keys(lead[at[now], k], k, level[now] + 1))]
                    level[now] += 1
                # other pieces in each order, so that the orders connect them
                piece = C.mix(s.node[at, 0] ^ _U(k + 1)) & ((_U(1) << level.astype(_U)) - _U(1))
                own.append(at)
                gid.append(C.mix(_lead_keys(lead[at, k], k, 0) + piece))
            own, gid = np.concatenate(own), np.concatenate(gid).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(gid), names(s.node[own]), pa.array(s.n[own].astype(np.int64)), s.blobs(own)], ["gid", "node", "n", "tokens"])

    return run


def _sets_of(words: int, seed: int, rows):
    """The sets of wanted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, bounds in C.chunks(batches):
            s = Sets(data, bounds, words, seed)
            own = np.flatnonzero(rows.value.test(batch.column("row").to_numpy().view(_U)) & (s.n > 0))
            yield pa.RecordBatch.from_arrays([names(s.node[own]), s.blobs(own)], ["node", "tokens"])

    return run


def _overlaps(flag: np.ndarray, flat: np.ndarray, head: np.ndarray) -> np.ndarray:
    return np.add.reduceat(flag[flat], head).astype(np.int64)


def link_group(sizes: np.ndarray, tokens: list[np.ndarray], percent: int) -> np.ndarray:
    """The component of each set of a group by exact comparison."""
    n = len(sizes)
    union, flat = np.unique(np.concatenate(tokens), return_inverse=True)
    first = np.concatenate([[0], np.cumsum(sizes)])
    label = np.full(n, -1)
    for start in np.argsort(-sizes, kind="stable").tolist():
        if label[start] >= 0:
            continue
        label[start], queue = start, [start]
        while queue:
            i = queue.pop()
            rest = np.flatnonzero((label < 0) & (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i])))
            if not len(rest):
                continue
            flag = np.zeros(len(union), bool)
            flag[flat[first[i] : first[i + 1]]] = True
            both = _overlaps(flag, flat[C.ragged(first[rest], sizes[rest])], np.cumsum(sizes[rest]) - sizes[rest])
            hit = rest[100 * both >= percent * (sizes[i] + sizes[rest] - both)]
            label[hit] = start
            queue += hit.tolist()
    return label


def _link_groups(percent: int):
    """Rows (gid, node, n, tokens) of many groups: a star of nodes for each component of a group."""

    def run(table: pa.Table) -> pa.Table:
        gid, node = table.column("gid").to_numpy(), numbers(table.column("node"))
        order = np.lexsort((node[:, 1], node[:, 0], gid))
        gid, node = gid[order], node[order]
        new = np.ones(len(gid), bool)
        new[1:] = (gid[1:] != gid[:-1]) | (node[1:] != node[:-1]).any(1)  # rows that repeat were sent twice
        gid, node, rows = gid[new], node[new], table.take(pa.array(order[new]))
        size, tokens = rows.column("n").to_numpy(), rows.column("tokens")
        cut = np.flatnonzero(np.concatenate([[True], gid[1:] != gid[:-1], [True]]))
        u, v = [np.zeros((0, 2), _U)], [np.zeros((0, 2), _U)]
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if b - a > 1:
                label = a + link_group(size[a:b], [np.frombuffer(t, _U) for t in tokens[a:b].to_pylist()], percent)
                other = np.flatnonzero(label != np.arange(a, b))
                u.append(node[label[other]])
                v.append(node[a + other])
        C.release()
        return pa.table({"u": names(np.concatenate(u)), "v": names(np.concatenate(v))})

    return run


def _open_groups(percent: int):
    """Rows of groups (kind 0) and of their queries (kind 1): the query's overlap with the union first, then each member."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("gid", "ascending"), ("slot", "ascending"), ("kind", "ascending")])
        gid, slot, kind, size = (rows.column(c).to_numpy() for c in ("gid", "slot", "kind", "n"))
        comp, tokens = rows.column("comp").to_pylist(), rows.column("tokens")
        cut = np.flatnonzero(np.concatenate([[True], (gid[1:] != gid[:-1]) | (slot[1:] != slot[:-1]), [True]]))
        edges = set()
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            q = a + int((kind[a:b] == 0).sum())
            if q in (a, b):
                continue
            union, flat = np.unique(np.concatenate([np.frombuffer(t, _U) for t in tokens[a:q].to_pylist()]), return_inverse=True)
            head = np.cumsum(size[a:q]) - size[a:q]
            for i in range(q, b):
                own = np.frombuffer(tokens[i].as_py(), _U)
                place = np.minimum(np.searchsorted(union, own), len(union) - 1)
                inside = place[union[place] == own]
                if 100 * len(inside) < percent * size[i]:
                    continue  # no member can reach the similarity
                flag = np.zeros(len(union), bool)
                flag[inside] = True
                both = _overlaps(flag, flat, head)
                for j in np.flatnonzero(100 * both >= percent * (size[i] + size[a:q] - both)).tolist():
                    if comp[a + j] != comp[i]:
                        edges.add((comp[i], comp[a + j]))
        C.release()
        return pa.table({"u": pa.array([u for u, _ in edges], pa.binary()), "v": pa.array([v for _, v in edges], pa.binary())})

    return run


def _renamed(rows: DataFrame, edges: DataFrame, column: str = "comp") -> DataFrame:
    """rows with the column's nodes renamed by the components of edges."""
    found = connected(edges).withColumnsRenamed({"node": column, "component": "_to"})
    return rows.join(found, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")


def node_components(texts: DataFrame, members: DataFrame, words: int, percent: int, seed: int = 0) -> DataFrame:
    """(node, comp) of all nodes. texts: row, text; members: row, node, n and the leads of each text.

    row is a hash of the row; it tells which of a node's texts is read for its
    tokens. If two rows share it, their tokens are sent twice, nothing else.
    """
    spark, driver = texts.sparkSession, []
    nodes = members.filter("node IS NOT NULL").groupBy("node").agg(F.min("row").alias("row"), F.any_value("n").alias("n"), *[F.any_value(c).alias(c) for c in LEADS])
    nodes = C.checkpoint(nodes)
    total = nodes.agg(F.sum("n")).first()[0] or 0
    counted, prefixes = C.buckets(spark, size=3 * total), C.buckets(spark, size=32 * total * (100 - percent) // 100)

    # groups of nodes with one least token
    pairs = nodes.select("row", "n", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("lead")) for k, c in enumerate(LEADS)])).alias("x")).select("row", "n", "x.*")
    leads = pairs.groupBy("k", "lead").agg(F.count("*").alias("c"), F.sum("n").alias("tokens")).filter("c > 1")
    leads = C.checkpoint(leads.select("k", "lead", F.ceil(F.log2(F.greatest(F.col("c") / GROUP, F.col("tokens") / GROUP_TOKENS, F.lit(1.0)))).cast("int").alias("level"), "tokens"))
    sent = leads.agg(F.sum("tokens")).first()[0] or 0
    edges = spark.createDataFrame([], "u binary, v binary")
    if sent:
        wanted = C.filter_of(pairs.join(leads, ["k", "lead"], "left_semi").select("row").distinct(), "row")
        by_lead = C.filter_of(leads.select("k", "lead", "level").mapInArrow(_levels, "key long"), "key")
        driver += [wanted, by_lead]
        n = C.buckets(spark, size=8 * sent)
        grouped = texts.mapInArrow(_grouped_sets(words, seed, wanted, by_lead), "gid long, node binary, n long, tokens binary").withColumn("bucket", F.pmod("gid", F.lit(n)))
        edges = C.grouped(grouped, n).applyInArrow(_link_groups(percent), "u binary, v binary")
    nodes = C.checkpoint(_renamed(nodes.select("node", "row", "n", "lead0", F.col("node").alias("comp")), edges))

    # first tokens that nodes of several components have
    counts = C.grouped(texts.select("text").mapInArrow(_counted_blobs(words, seed, counted), BLOBS), counted).applyInArrow(_survey(counted), "bucket int, bits binary, tokens binary, sets binary")
    order = spark.sparkContext.broadcast(Order(counted, counts.collect()))  # rows of bounded size together
    driver.append(order)
    firsts = C.grouped(texts.select("text").mapInArrow(_prefix_blobs(words, seed, percent, prefixes, order), BLOBS), prefixes).applyInArrow(_shared(percent, order), "token long, node binary, n long, reach long")
    firsts = C.checkpoint(firsts.distinct().join(nodes.select("node", "comp"), "node"))
    several = firsts.groupBy("token").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a < b").select("token")
    open_ = C.checkpoint(firsts.join(several, "token", "left_semi"))
    left = open_.count()
    if left:
        k = tasks(left)
        open_ = open_.coalesce(k)
        inside = C.checkpoint(nodes.join(open_.select("node").distinct(), "node", "left_semi").coalesce(k))
        sizes = inside.groupBy("lead0").agg(F.ceil(F.greatest(F.count("*") / GROUP, F.sum("n") / GROUP_TOKENS)).alias("pieces"))
        place = inside.join(sizes, "lead0").select("node", F.xxhash64("lead0", F.pmod(F.xxhash64("node"), "pieces")).alias("gid"))
        open_ = C.checkpoint(open_.join(place, "node").coalesce(k))
        # a token's largest component is asked by the others
        largest = open_.groupBy("token", "comp").agg(F.count("*").alias("c")).groupBy("token").agg(F.max_by("comp", F.struct("c", "comp")).alias("top"))
        groups = open_.groupBy("token", "gid").agg(F.min("n").alias("low"), F.max("reach").alias("far"), F.min("comp").alias("a"), F.max("comp").alias("b"))
        asking = open_.drop("gid").join(largest, "token").filter("comp <> top").drop("top")
        near = (F.col("far") >= percent * F.col("n")) & (F.col("reach") >= percent * F.col("low"))
        asked = asking.join(groups, "token").filter(near & ((F.col("a") != F.col("comp")) | (F.col("b") != F.col("comp")))).select("node", "comp", "n", "gid").distinct()
        asked = C.checkpoint(asked)
        slots = asked.groupBy("gid").agg(F.ceil(F.count("*") / ASKING).alias("slots"))
        queries = asked.join(slots, "gid").select("node", "comp", "n", "gid", F.pmod(F.xxhash64("node"), "slots").alias("slot"), F.lit(1).alias("kind"))
        held = place.join(nodes, "node").join(slots, "gid").select("node", "comp", "n", "gid", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), F.lit(0).alias("kind"))
        dealt = C.checkpoint(queries.unionByName(held))  # read several times from here on
        needed = C.filter_of(inside.join(dealt.select("node").distinct(), "node", "left_semi").select("row"), "row")
        driver.append(needed)
        tokens = texts.mapInArrow(_sets_of(words, seed, needed), "node binary, tokens binary").groupBy("node").agg(F.any_value("tokens").alias("tokens"))
        sent = dealt.agg(F.sum("n")).first()[0] or 0
        n = C.buckets(spark, size=8 * sent)
        rows = tokens.join(dealt, "node").withColumn("bucket", F.pmod(F.xxhash64("gid", "slot"), F.lit(n)))
        nodes = C.checkpoint(_renamed(nodes, C.grouped(rows, n).applyInArrow(_open_groups(percent), "u binary, v binary")))
    for shared in driver:  # all that used them is checkpointed
        shared.destroy()
    return nodes.select("node", "comp")


def _placed(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """The columns of rows (row and others) without text, with n, node and comp, which are null for a text without words."""
    kept, seed = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text"), C.draw()
    members = C.checkpoint(rows.mapInArrow(_members(words, seed), f"{kept}, node binary, n long, " + ", ".join(f"{c} long" for c in LEADS)))
    found = node_components(rows.select("row", "text"), members, words, percent, seed)
    return members.drop(*LEADS).join(found, "node", "left")


def join(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links) of each row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    placed = C.checkpoint(_placed(docs.withColumn("row", F.xxhash64("doc_id", "text")), words, percent))
    least = placed.filter("comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("least"))
    out = placed.join(least, "comp", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def _passing(bloom):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("hash").to_numpy(zero_copy_only=False).view(_U)
            yield batch.filter(pa.array(bloom.value.test(keys)))

    return run


def clean(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component: the smallest id, then the least hash of id and text, then the least hash of the other columns.

    Null ids come after all others. Texts without words are linked with nothing, so of them
    only repeats of an id and text go; those of null id all stay.
    """
    rows = C.keyed(docs)
    placed = _placed(rows.select("key", "doc_id", "text", F.xxhash64("doc_id", "text").alias("row")), words, percent)
    own = F.col("comp").isNull()
    copies = placed.groupBy(own.alias("own"), F.coalesce("comp", "key").alias("comp"), "doc_id", "key").agg(F.count("*").alias("copies"))
    first = copies.groupBy("own", "comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "key", "copies")).alias("first")).select("own", "first.*")
    first = C.checkpoint(first.select("key", ((F.col("copies") == 1) | (F.col("own") & F.col("unknown"))).alias("single")))
    kept = rows.join(first.filter("single").select("key"), "key", "left_semi")
    several = first.filter("NOT single").select("key", F.xxhash64("key").alias("hash"))
    if not several.isEmpty():
        # only rows that repeat an id and text are brought together
        kind = rows.schema["row"].dataType.simpleString()
        some = rows.withColumn("hash", F.xxhash64("key")).mapInArrow(_passing(C.filter_of(several, "hash")), f"key binary, doc_id long, text string, row {kind}, hash long")
        some = some.join(several.select("key"), "key", "left_semi").withColumn("_by", F.xxhash64(F.to_json("row")))
        some = some.groupBy("key").agg(F.min_by(F.struct("doc_id", "text", "row"), "_by").alias("_one")).select("key", "_one.*")
        kept = kept.select("key", "doc_id", "text", "row").unionByName(some)
    return C.unkeyed(kept, docs)
