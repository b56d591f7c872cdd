import re

from quillspark.llm import line_templates as L

WORD = r"[^\x20\x09-\x0D]+"


def brute(docs, least=5, share=0.5):
    """docs: (id, text). The same templates by plain dictionaries."""
    lines, leaves = [], {}
    for n, (doc_id, text) in enumerate(docs):
        for k, line in enumerate((text or "").split("\n")):
            tokens = tuple("*" if re.search("[0-9]", w) else w for w in re.findall(WORD, line))
            if len(tokens) >= L.LEAST:
                lines.append((n, k, tokens))
                leaves.setdefault((len(tokens), tokens[: L.DEPTH]), set()).add(n)
    inner = [x for x in lines if len(leaves[len(x[2]), x[2][: L.DEPTH]]) >= least]
    have = {}
    for n, _, t in inner:
        have.setdefault(t, set()).add(n)
    counts = {}
    for t, ns in have.items():
        for p, w in enumerate(t):
            key = (len(t), t[: L.DEPTH], p, w)
            counts[key] = counts.get(key, 0) + len(ns)
    template, total, home = {}, {}, {}
    for t, ns in have.items():
        fixed = tuple((p, w) for p, w in enumerate(t) if w != "*" and counts[len(t), t[: L.DEPTH], p, w] >= least)
        if len(fixed) and len(fixed) >= share * len(t):
            template[t] = key = (len(t), t[: L.DEPTH], fixed)
            total[key] = total.get(key, 0) + len(ns)
            ids = [docs[n][0] for n in ns if docs[n][0] is not None]
            home[key] = min([*ids, *([home[key]] if home.get(key) is not None else [])], default=None)
    out = []
    for n, (doc_id, text) in enumerate(docs):
        if text is None:
            out.append((doc_id, None))
            continue
        gone = {k for m, k, t in inner if m == n and t in template and total[template[t]] >= least and not (doc_id == home[template[t]])}
        parts = text.split("\n")
        kept = "".join(p + ("\n" if k + 1 < len(parts) else "") for k, p in enumerate(parts) if k not in gone)
        out.append((doc_id, kept))
    return out


def test_against_brute_force(spark):
    docs = [(i, f"Own line number {'abcdefghij'[i]} with words {'klmnopqrst'[i]}\nUser u{i} logged in from host{i} today\nSome unique {'xyzuvwabcd'[i]} tail {'xyzuvwabcd'[i] * 3} here end{i}x") for i in range(10)]
    docs += [(10, "x\n\nCopyright by the authors of this text\nshort one"), (11, None), (12, ""), (None, "Copyright by the authors of this text")]
    docs += [(20 + i, f"before it {i}\nCopyright by the authors of this text\nPosted by {'Ann Bob Cid Dan Eve Fay'.split()[i]} on the wall today") for i in range(6)]
    docs += [(20, docs[14][1]), (13, "no\nCopyright by the authors of this text")]
    d = spark.createDataFrame([(*r, "z", 1) for r in docs], "doc_id long, text string, key string, places int").repartition(4)
    out = L.drop_lines(d)
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted(brute(docs), key=str)
    clean = L.clean(d)
    assert clean.columns == d.columns
    assert L.drop_lines(d.limit(0)).count() == 0


def test_given_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = L.drop_lines(docs)
    assert sorted((r.doc_id, r.text) for r in out.collect()) == sorted(brute(rows))
    assert sum(r.n_dropped for r in out.select("n_dropped").collect()) > 0


def test_short_lines(spark):
    """Expected rows are written out, so they depend on no constant of the operator."""
    notice, page = "All rights reserved.", "Page {}"
    docs = [(i, f"{'abcdef'[i]}{'abcdef'[i]}\n{notice}\n \nShare\n{page.format(i)}\n{i} {i} {i}\n{'rare' if i < 4 else 'other' + 'abcdef'[i]}") for i in range(6)]
    want = [docs[0]] + [(i, f"{'abcdef'[i]}{'abcdef'[i]}\n \n{i} {i} {i}\n{'rare' if i < 4 else 'other' + 'abcdef'[i]}") for i in range(1, 6)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = L.drop_lines(d).collect()
    assert sorted((r.doc_id, r.text) for r in rows) == want
    assert sorted(r.n_dropped for r in rows) == [0] + [3] * 5


def test_identical_lines_of_digits(spark):
    version, date = "v1.2 build 345 2024-01-01", "2024-01-01"
    docs = [(i, f"{'abcdef'[i]}{'abcdef'[i]}\n{version}\n{date}\nv1.2 build 345 2024-01-0{i + 2}\n{i} 7 8 9") for i in range(6)]
    want = [docs[0]] + [(i, f"{'abcdef'[i]}{'abcdef'[i]}\nv1.2 build 345 2024-01-0{i + 2}\n{i} 7 8 9") for i in range(1, 6)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert sorted((r.doc_id, r.text) for r in L.drop_lines(d).collect()) == want
    few = d.filter("doc_id < 4")
    assert sum(r.n_dropped for r in L.drop_lines(few).collect()) == 0


def test_long_lines_and_texts(spark):
    """A line of many tokens that several documents share, and a text of many lines."""
    line = " ".join(f"x{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(100_000))
    docs = [(i, f"own {'abcdef'[i]}\n{line}\n" + "\n".join(f"{'abcdef'[i]} row {'abcdefghij'[k % 10] * (k % 40 + 1)}" for k in range(8000))) for i in range(6)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.text) for r in L.drop_lines(d).collect())
    assert got == sorted(brute(docs)) and line in got[0][1] and all(line not in t for _, t in got[1:])
