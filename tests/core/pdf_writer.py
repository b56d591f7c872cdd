"""Writes PDF files for the tests, each part as the format describes it; knows nothing of the reader."""

import struct
import zlib


def flate(data):
    return b"/Filter /FlateDecode", zlib.compress(data)


def predicted(data, columns, kind=12):
    """Deflated with a PNG predictor (up) in rows of so many bytes."""
    rows, before = [], bytes(columns)
    for at in range(0, len(data), columns):
        row = data[at : at + columns].ljust(columns, b"\0")
        rows.append(b"\x02" + bytes((x - y) & 255 for x, y in zip(row, before, strict=True)))
        before = row
    return b"/Filter /FlateDecode /DecodeParms << /Predictor %d /Columns %d >>" % (kind, columns), zlib.compress(b"".join(rows))


def stream(data, extra=b"", pack=None):
    head, body = pack(data) if pack else (b"", data)
    return b"<< /Length %d %s %s >>\nstream\n%s\nendstream" % (len(body), head, extra, body)


def classic(objects, root=1, order=None, trailer=b""):
    """A file with a cross-reference table; objects: number -> bytes; order: how they follow each other in the file."""
    out, places = b"%PDF-1.4\n%\xe2\xe3\xcf\xd3\n", {}
    for number in order or sorted(objects):
        places[number] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (number, objects[number])
    at, size = len(out), max(objects) + 1
    out += b"xref\n0 %d\n0000000000 65535 f \n" % size
    for number in range(1, size):
        out += b"%010d 00000 %s \n" % (places.get(number, 0), b"n" if number in places else b"f")
    return out + b"trailer\n<< /Size %d /Root %d 0 R %s >>\nstartxref\n%d\n%%%%EOF\n" % (size, root, trailer, at)


def compressed(objects, streams, root=1, pack=flate):
    """A file whose plain objects are in an object stream and whose places are in a cross-reference stream."""
    inner, outer = sorted(objects), max([*objects, *streams]) + 1
    heads, bodies = [], b""
    for number in inner:
        heads.append(b"%d %d" % (number, len(bodies)))
        bodies += objects[number] + b" "
    head = b" ".join(heads) + b" "
    written = streams | {outer: stream(head + bodies, b"/Type /ObjStm /N %d /First %d" % (len(inner), len(head)), flate)}
    out, places = b"%PDF-1.5\n", {}
    for number, body in written.items():
        places[number] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (number, body)
    at, table = len(out), outer + 1
    places[table] = at
    rows = b""
    for number in range(table + 1):
        if number in inner:
            rows += struct.pack(">BIB", 2, outer, inner.index(number))
        else:
            rows += struct.pack(">BIB", int(number in places), places.get(number, 0), 0)
    body = stream(rows, b"/Type /XRef /Size %d /W [1 4 1] /Root %d 0 R" % (table + 1, root), pack)
    return out + b"%d 0 obj\n%s\nendobj\nstartxref\n%d\n%%%%EOF\n" % (table, body, at)


FONT = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding /FirstChar 32 /LastChar 126 /Widths [%s] >>" % b" ".join([b"500"] * 95)


def document(contents, font=FONT, pack=None, pages_order=None, more=None, resources=b""):
    """The objects of a file with a page for each of contents: catalog 1, page tree 2, font 3, then pages and contents."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: font} | (more or {})
    kids = []
    for i, content in enumerate(contents):
        page = 10 + 2 * i
        objects[page] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (page + 1)
        objects[page + 1] = stream(content, pack=pack)
        kids.append(b"%d 0 R" % page)
    kids = [kids[i] for i in pages_order] if pages_order else kids
    objects[2] = b"<< /Type /Pages /Count %d /Kids [%s] /Resources << /Font << /F1 3 0 R >> %s >> >>" % (len(kids), b" ".join(kids), resources)
    return objects


def shown(text, x=72, y=700):
    return b"BT /F1 12 Tf %d %d Td %s Tj ET" % (x, y, text)
