"""Kernels: values carried over from the behaviour to match, round trips and malformed input."""

from __future__ import annotations

import random
import sys
import time
import zlib

import pytest

from parchlake import api
from parchlake.functions.chunking import chunked, hard_split, options, overlap_tail
from parchlake.kernel import crypt, edit, filters, text
from parchlake.kernel.document import Document
from parchlake.kernel.model import HexBytes, Keyword, Name, Parser, PdfError, Ref, Stream, serialize
from parchlake.plans import fixtures
from parchlake.sources.pdf import rows_of


def nested(n: int) -> Document:
    """Pages on two levels of unequal depth: the last one hangs from the root itself."""
    doc, page = Document("1.4"), lambda i, up: {"Type": Name("Page"), "Parent": up, "Label": i}
    root, left, deep = Ref(7), Ref(9), Ref(11)
    own = [Ref(20 + 3 * i) for i in range(n)]
    doc.objects = {Ref(5): {"Type": Name("Catalog"), "Pages": root}, root: {"Type": Name("Pages"), "Kids": [left, own[-1]], "Count": n, "MediaBox": [0, 0, 612, 792], "Rotate": 90}}
    doc.objects |= {left: {"Type": Name("Pages"), "Parent": root, "Kids": [deep, *own[1:-1]], "Count": n - 1}, deep: {"Type": Name("Pages"), "Parent": left, "Kids": own[:1] if n > 1 else [], "Count": int(n > 1), "CropBox": [1, 2, 300, 400]}}
    doc.objects |= {r: page(i, root if i == n - 1 else deep if i == 0 else left) for i, r in enumerate(own)}
    doc.trailer = {"Root": Ref(5)}
    return doc


def markers(doc: Document) -> list[int]:
    return [doc.dict_of(r)["Label"] for r in doc.page_refs()]


def with_content(body: bytes) -> Document:
    doc = edit.text_document(["x"])
    page = doc.dict_of(doc.page_refs()[0])
    doc.objects[page["Contents"]] = Stream({}, body)
    return doc


def shown(body: bytes) -> str:
    return text.document_text(with_content(body))


@pytest.mark.parametrize(("spec", "n", "want"), [("", 3, [0, 1, 2]), ("1-2,4", 5, [0, 1, 3]), ("3", 3, [2]), ("2,1,2", 2, [1, 0, 1])])
def test_ranges(spec, n, want):
    assert edit.ranges(spec, n) == want


@pytest.mark.parametrize(("spec", "code"), [("0", "ERROR"), ("4", "PAGE_OUT_OF_RANGE"), ("2-1", "ERROR"), ("x", "ERROR"), (",", "ERROR")])
def test_bad_ranges(spec, code):
    with pytest.raises(PdfError) as e:
        edit.ranges(spec, 3)
    assert e.value.code == code


def test_rotation_accumulates_and_checks():
    doc = nested(2)
    assert edit.rotation(doc, 0) == 90
    assert edit.rotation(edit.rotate(doc, [0], 90), 0) == 180
    assert edit.rotation(edit.rotate(doc, [0], -270), 0) == 270
    with pytest.raises(PdfError):
        edit.rotate(doc, [0], 45)


def test_extract_merge_delete_reorder():
    out = edit.extract(nested(4), [3, 1, 1])
    assert markers(out) == [3, 1, 1] and edit.rotation(out, 0) == 90 and edit.media_box(out, 0) == (0, 0, 612, 792) and edit.crop_box(edit.extract(nested(4), [0]), 0) == (1, 2, 300, 400)
    assert markers(Document.load(out.to_bytes())) == [3, 1, 1]
    assert markers(edit.merge([nested(2), nested(3)])) == [0, 1, 0, 1, 2]
    assert markers(edit.delete(nested(4), [1, 2])) == [0, 3]
    assert markers(edit.reorder(nested(3), [2, 0, 1])) == [2, 0, 1]
    assert [markers(d) for d in edit.split(nested(2))] == [[0], [1]]
    for bad in ([0, 0, 1], [0]):
        with pytest.raises(PdfError):
            edit.reorder(nested(3), bad)
    with pytest.raises(PdfError):
        edit.delete(nested(2), [0, 1])


@pytest.mark.parametrize(
    ("body", "want"),
    [
        (b"BT /F1 12 Tf 10 700 Td (Hello) Tj 100 0 Td (world) Tj ET", "Hello world"),
        (b"BT /F1 12 Tf 10 700 Td (Line one) Tj 0 -14 Td (Line two) Tj ET", "Line one\nLine two"),
        (b"BT /F1 12 Tf 14 TL 10 700 Td [(Wor) -20 (ld)] TJ (next) ' ET", "World\nnext"),
        (b"BT /F1 12 Tf 10 700 Td (a) Tj ET BI /W 1 ID xx EI BT (b) Tj ET", "a\n\nb"),
        (b"BT /F1 12 Tf (a) Tj ) ET", ""),
    ],
)
def test_text(body, want):
    assert shown(body) == want


def test_cmap_and_widths():
    m = text.read_cmap(b"2 beginbfchar <41> <0042> <42> <00480069> endbfchar 2 beginbfrange <50> <52> <0061> <60> <61> [<0078> <0079>] endbfrange")
    assert (m[0x41], m[0x42], m[0x50], m[0x52], m[0x60], m[0x61]) == ("B", "Hi", "a", "c", "x", "y")
    w = text.cid_widths([1, [500, 600], 10, 12, 250])
    assert (w[1], w[2], w[11]) == (500, 600, 250)


def test_filters():
    assert filters.decode_stream({"Filter": Name("FlateDecode")}, zlib.compress(b"hi")) == b"hi"
    assert filters.ascii85(b"87cURDZ~>") == b"Hello"
    assert filters.ascii_hex(b"48 65 6C6c 6>") == b"Hell`"
    png = bytes([2, 1, 2, 3, 4, 2, 1, 1, 1, 1])
    assert filters.unpredicted(png, {"Predictor": 12, "Columns": 4}) == bytes([1, 2, 3, 4, 2, 3, 4, 5])
    assert filters.unpredicted(bytes([1, 1, 1, 255, 2, 3]), {"Predictor": 2, "Columns": 3}) == bytes([1, 2, 3, 255, 1, 4])
    with pytest.raises(PdfError):
        filters.decode_stream({"Filter": Name("LZWDecode")}, b"")


def test_values_round_trip():
    v = {"A": [1, -2.5, True, None, Ref(3, 1)], "B": b"a(b)\\\n\xff", "C": HexBytes(b"\x01\xab"), "D e": Name("x#y z")}
    assert Parser(serialize(v)).value() == v
    assert Parser(b"(a\\\nb\\101\\)(c))").value() == b"abA)(c)"


def test_crypto():
    assert crypt.rc4(b"Key", b"Plaintext").hex().upper() == "BBF316E8D940AF0AD3"
    key, iv, block = bytes(range(16)), bytes(16), bytes(range(32))
    by_hand, last = b"", iv
    for i in (0, 16):
        last = crypt._Aes(key).encrypt(bytes(a ^ b for a, b in zip(block[i : i + 16], last, strict=True)))
        by_hand += last
    assert crypt.cbc(key, iv, block, True) == by_hand and crypt._Aes(key).decrypt(by_hand[:16]) == block[:16]
    k = bytes(range(32))
    assert crypt.aes_decrypt(k, crypt.aes_encrypt(k, b"secret")) == b"secret" and crypt.aes_decrypt(k, b"short") == b""


def test_encryption_outcomes():
    data = edit.text_document(["hidden words"], "Title é").to_bytes()
    locked = api.encrypt(data, "user", "owner")
    for pw, code in (("", "ENCRYPTED"), ("bad", "WRONG_PASSWORD")):
        with pytest.raises(PdfError) as e:
            api.page_count(locked, pw)
        assert e.value.code == code
    for pw in ("user", "owner"):
        assert api.extract_text(locked, password=pw) == "hidden words" and api.get_metadata(locked, pw)["title"] == "Title é"
    assert api.inspect(locked, "user")["encrypted"] and not api.inspect(api.decrypt(locked, "user"))["encrypted"]


def test_metadata_updates():
    data = edit.text_document(["x"], "old").to_bytes()
    got = api.get_metadata(api.set_metadata(data, {"author": "తెలుగు", "other": "x"}))
    assert got["title"] == "old" and got["author"] == "తెలుగు"
    assert api.get_metadata(api.set_metadata(data, {"title": ""}))["title"] is None


def test_streams_of_objects():
    head = b"10 0 11 5 "
    body = head + b"(hi) 42"
    pdf = bytearray(b"%PDF-1.5\n")
    at = {}
    for n, v in ((1, {"Type": Name("Catalog"), "Pages": Ref(2)}), (2, {"Type": Name("Pages"), "Kids": [], "Count": 0}), (3, Stream({"Type": Name("ObjStm"), "N": 2, "First": len(head), "Filter": Name("FlateDecode")}, zlib.compress(body)))):
        at[n] = len(pdf)
        pdf += b"%d 0 obj\n%s\nendobj\n" % (n, serialize(v))
    at[4] = len(pdf)
    rows = b"".join(bytes([1]) + at[n].to_bytes(2, "big") + b"\0" for n in (1, 2, 3, 4)) + b"\x02\x00\x03\x00" + b"\x02\x00\x03\x01"
    pdf += b"4 0 obj\n%s\nendobj\nstartxref\n%d\n%%%%EOF" % (serialize(Stream({"Type": Name("XRef"), "W": [1, 2, 1], "Index": [1, 4, 10, 2], "Size": 12, "Root": Ref(1)}, rows)), at[4])
    doc = Document.load(bytes(pdf))
    assert doc.objects[Ref(10)] == b"hi" and doc.objects[Ref(11)] == 42 and doc.inspect().page_count == 0


def test_newest_revision_wins():
    first = edit.text_document(["x"], "one").to_bytes()
    info = Document.load(first).trailer["Info"]
    second = first + b"%d 0 obj\n<</Title (two)>>\nendobj\n" % info.num
    xref = len(second)
    start = int(first.rsplit(b"startxref\n", 1)[1].split()[0])
    second += b"xref\n%d 1\n%010d 00000 n \ntrailer\n<</Root %d 0 R /Info %d 0 R /Size 99 /Prev %d>>\nstartxref\n%d\n%%%%EOF\n" % (info.num, len(first), Document.load(first).trailer["Root"].num, info.num, start, xref)
    assert api.get_metadata(second)["title"] == "two"


@pytest.mark.parametrize("bad", [b"", b"%PDF-1.4", b"no", b"%PDF-1.4\nstartxref\n9999", b"%PDF-1.4\nxref\n0 1\n)", b"%PDF-1.4\nxref\n1 1\n0000000000 00000 n \ntrailer\n<<>>\nstartxref\n9\n"])
def test_malformed_ends(bad):
    with pytest.raises(PdfError):
        Document.load(bad)


def test_chunks():
    assert options(0, -1) == (2000, 200) and options(10, 100) == (64, 32)
    assert [x[:2] for x in chunked([(0, "a"), (1, "b")], 64, 0)] == [(0, 1)]
    paras = "\n\n".join(c * 150 for c in "abc")
    assert all(len(t) <= 260 for _, _, t in chunked([(0, paras)], 200, 40))
    assert all(len(x) <= 200 for x in hard_split("word. " * 200, 200, 40)) and hard_split("x" * 1100, 200, 40)[0] == "x" * 200
    assert overlap_tail("one two three", 7) == "three" and overlap_tail("abc", 9) == "abc" and overlap_tail("abcdef", 3) == ""
    assert chunked([(0, " 　\n\n\n\n")], 64, 0) == []


def test_export():
    data = edit.text_document(["AI export test text."], "Export sample").to_bytes()
    assert '"title": "Export sample"' in api.export(data) and '"AI export test text."' in api.export(data)
    assert [x[:8] for x in api.export(data, lines=True).splitlines()] == ['{"schema', '{"kind":']


def test_glyph_names():
    from parchlake.kernel.text import glyph

    assert [glyph(x) for x in ("dagger", "daggerdbl", "uni0915", "uni09150916", "uni0041.alt", "u1F600", "uni09", "A")] == ["†", "‡", "क", "क", "A", "😀", "", "A"]


def test_text_documents_keep_every_character():
    texts = ["a\rb 漢字 😀 x\tq (y) \\", "plain é (z)\nsecond", ""]
    assert [text.page_text(d, r) for d in [Document.load(edit.text_document(texts).to_bytes())] for r in d.page_refs()] == texts


def test_widths_pass_over_what_is_malformed():
    assert text.cid_widths([b"x", 1, [500, None, 600], 2, b"y", 10, 12, 250, 20, 21, b"z", 30]) == {1: 500, 3: 600, 10: 250, 11: 250, 12: 250}


def test_broken_unicode_map_and_standard_encoding():
    from parchlake.plans.fixtures import many_fonts

    doc = Document.load(many_fonts("it's `x`", "AB!c", "c", "漢😀", "e").to_bytes())
    assert text.document_text(doc).split("\n\n") == ["it's `x`", "AB!c", "c", "漢😀", "e"]
    assert text.base_encoding(None)[0xB4] == "·" and 0xAA not in text.base_encoding(None)


def test_merge_takes_the_first_info_that_is_there():
    a, b = edit.text_document(["a"]), edit.text_document(["b"], "kept")
    a.trailer["Info"] = Ref(999)
    assert edit.metadata(edit.merge([a, b]))["title"] == "kept"


def test_lists_of_files_and_round_trips(tmp_path):
    for n in "ab":
        (tmp_path / f"{n}.pdf").write_bytes(edit.text_document([n]).to_bytes())
    merged = api.merge_list(f"  {tmp_path}/a.pdf \n\n{tmp_path}/b.pdf\n")
    assert api.extract_text(merged) == "a\fb" and api.roundtrip(merged) == (8, 2)
    with pytest.raises(PdfError):
        api.merge_list(" \n")


def test_command_line(tmp_path, capsys):
    from parchlake.__main__ import main

    a, b, c = (str(tmp_path / f"{n}.pdf") for n in "abc")
    (tmp_path / "a.pdf").write_bytes(edit.text_document(["one", "two", "three"]).to_bytes())
    runs = [
        (["split", a, "3,1", b], 0), (["merge", c, a, b], 0), (["delete", a, "", b], 1), (["delete", a, "4", b], 1), (["rotate", a, "90", b], 0), (["meta-set", a, '{"title": "T"}', b], 0), (["meta-get", b], 0),
        (["text", a, "2"], 0), (["text", c], 0), (["roundtrip", a], 0), (["encrypt", a, "u", "o", c], 0), (["inspect", c], 1), (["decrypt", c, "o", b], 0), (["reorder", a, "3,2,1", b], 0), (["rewrite", a, b], 0), (["export", a, "ndjson"], 0), (["nothing"], 2), (["split", a], 2),
    ]
    assert [(args, main(args)) for args, _ in runs] == runs
    out = capsys.readouterr().out
    assert "(5 pages)" in out and '"title": "T"' in out and "--- page 5 ---\none" in out and "ok: " in out


def test_split_and_merge_are_inverse():
    rnd = random.Random(6)
    for _ in range(20):
        texts = ["".join(rnd.choices("ab (é漢)\\", k=rnd.randrange(30))).strip() for _ in range(rnd.randrange(1, 6))]
        doc = edit.text_document(texts, "T")
        again = edit.merge([Document.load(d.to_bytes()) for d in edit.split(doc)])
        assert text.document_text(again) == "\f".join(texts) and edit.metadata(again)["title"] == "T"


def test_damaged_files_end_in_time():
    rnd, data = random.Random(7), edit.text_document(["first (page)", "漢字"], "T").to_bytes()
    began = time.monotonic()
    for _ in range(300):
        bad = bytearray(data)
        for _ in range(rnd.randrange(1, 8)):
            bad[rnd.randrange(len(bad))] = rnd.randrange(256)
        for level in ("meta", "pages", "text", "objects"):
            assert all("path" in r for r in rows_of(level, "x", bytes(bad[: rnd.choice([len(bad), rnd.randrange(len(bad))])])))
    assert time.monotonic() - began < 60


def _calls(f, *args):
    """How many functions a call runs, those in C too."""
    n = 0

    def count(frame, event, arg):
        nonlocal n
        n += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        f(*args)
    finally:
        sys.setprofile(None)
    return n


def test_no_calls_for_each_character():
    line = "a line of (plain) text, \\ and café " * 200
    data = edit.text_document([line]).to_bytes()
    doc = Document.load(data)
    page = doc.page_refs()[0]
    assert text.page_text(doc, page) == line.rstrip()
    assert _calls(text.page_text, doc, page) < len(line) / 4
    noted = edit.set_metadata(doc, {"title": "x" * 5000})
    assert _calls(noted.to_bytes) < 2500
    raw = bytes(range(256)) * 40
    assert _calls(fixtures.png_encoded, raw, 60, 3) < len(raw) / 4
    assert _calls(fixtures.tiff_encoded, raw, 60, 3) < len(raw) / 4
    held = fixtures.tiff_encoded(raw, 60, 3)
    assert _calls(filters.unpredicted, held, {"Predictor": 2, "Columns": 20, "Colors": 3}) < len(raw) / 100


def test_predictors_byte_by_byte():
    def undone(data, columns, unit):
        out, up = bytearray(), bytes(columns)
        for i in range(0, len(data), columns + 1):
            tag, x = data[i], bytearray(data[i + 1 : i + 1 + columns])
            for j in range(len(x)):
                a, b, c = (x[j - unit] if j >= unit else 0), up[j], (up[j - unit] if j >= unit else 0)
                x[j] = x[j] + (0, a, b, (a + b) // 2, min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2])[tag] & 255
            out += x
            up = bytes(x) + bytes(columns - len(x))
        return bytes(out)

    r = random.Random(7)
    for colors, columns, n in ((1, 1, 5), (3, 4, 0), (3, 4, 1), (3, 4, 100), (4, 3, 61), (2, 9, 19), (5, 1, 37), (9, 100, 8)):
        raw, p = r.randbytes(n), {"Predictor": 12, "Columns": columns, "Colors": colors}
        assert undone(fixtures.png_encoded(raw, colors * columns, colors), colors * columns, colors) == raw
        tagged = b"".join(bytes([r.randrange(5)]) + r.randbytes(colors * columns) for _ in range(12))
        for cut in (0, 1, colors * columns, colors * columns + 1):
            data = tagged[: len(tagged) - cut]
            assert filters.unpredicted(data, p) == undone(data, colors * columns, colors)
        assert filters.unpredicted(fixtures.tiff_encoded(raw, colors * columns, colors), p | {"Predictor": 2}) == raw


def test_plain_tokens_are_the_parsers():
    body = rb"/F1 12 Tf +3 -4.5 .5 Td (a(b)\)c) Tj (plain) Tj <4> Tj <4 1> Tj <</A 1>> [1 (x) -2]TJ true false null /N#41 x' y 5% note" + b"\n6 /N/M T* (z)' 123456789012345678 (a)\" q"
    p, want, held = Parser(body, references=False), [], []
    while not p.done():
        v = p.value()
        held.append(v)
        if isinstance(v, Keyword):
            want.append((str(held.pop()), held))
            held = []
    got = text.operations(body)
    assert got == want and [[type(x) for x in v] for _, v in got] == [[type(x) for x in v] for _, v in want]
