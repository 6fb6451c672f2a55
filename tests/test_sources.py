"""Files in many splits against whole-file parsers; damaged files; the table of errors."""

from __future__ import annotations

import csv
import io
import itertools
import json
import random
import zipfile

import pytest

from profusion.sources import splits
from profusion.sources.files import CSV_COLUMN_NAMES, docx_text, is_json, read_folder, recruiter_csv
from tests import fixtures


@pytest.fixture
def tiny_splits(spark):
    """Splits of a few hundred bytes."""
    own = {"spark.sql.files.maxPartitionBytes": "700b", "spark.sql.files.openCostInBytes": "1b"}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k in own:
        spark.conf.unset(k)


# ---------------------------------------------------------------- cuts, without Spark


def _splits(text: str, separator: str, cuts: list[int]):
    """A file's pieces by split, as the text source deals them: a split has the pieces that begin after its start, up to its end."""
    parts, closed = text.split(separator), text != "" and text.endswith(separator)
    parts = parts[:-1] if parts[-1] == "" else parts
    begins = [0, *itertools.accumulate(len(x) + 1 for x in parts[:-1])]
    for a, b in itertools.pairwise([0, *cuts, len(text) + 1]):
        own = [x for s, x in zip(begins, parts, strict=False) if s <= b and (a < s or not a)]
        if own:
            yield a, own, closed and begins[-1] <= b


def _cut(text: str, kind, cuts: list[int]):
    """Records in order, and the state at the file's end, by the two passes without Spark."""
    halves = lambda v: iter([v[: len(v) // 2], v[len(v) // 2 :]])
    own = list(_splits(text, kind.separator, cuts))
    marks = [kind.mark(halves(v), not a) for a, v, _ in own]
    listed, inside, depth, rows, begun = any(m[4] for m in marks), False, 0, [], []
    for (a, v, closed), m in zip(own, marks, strict=True):
        for local, part, cells, size, reason in kind.cut(halves(v), not a, inside, depth, listed, closed):
            if part in (splits.WHOLE, splits.WRONG):
                rows.append((a, local, cells, reason))
            elif part == splits.BEGINS:
                begun.append([a, local, cells or [], size])
            elif begun:
                begun[-1][2:] = begun[-1][2] + (cells or []), begun[-1][3] + size
            else:
                rows.append((a, local, None, "not JSON: an item without a beginning"))
        depth += m[3] if inside else m[2]
        inside = bool(m[1] if inside else m[0])
    for a, local, t, size in begun:
        rows += [(a, local + i, cells, reason) for i, (cells, _, reason) in enumerate(kind.finished(t, size, not a and not local))]
    return [r[2:] for r in sorted(rows, key=lambda r: r[:2])], inside, depth, listed


def test_csv_cuts_equal_the_whole_file_parser():
    draw = random.Random(7)
    symbols = ["a", '"', ",", "\n", "\r\n", '""', "x y", '"q"', "\r", '"p\nq"', "é"]
    for _ in range(3000):
        text = "".join(draw.choice(symbols) for _ in range(draw.randint(0, 40))) + draw.choice(["", "\n"])
        want = [r for k, r in enumerate(csv.reader(io.StringIO(text, newline=""))) if r or not k]
        cuts = sorted({draw.randrange(1, len(text)) for _ in range(draw.randint(0, 5))}) if len(text) > 1 else []
        got, inside, _, _ = _cut(text, splits.Csv(), cuts)
        got = [cells for cells, _ in got]
        if inside and not text.endswith("\n"):  # a quote that stays open: the last line gains its end
            got[-1][-1] = got[-1][-1].removesuffix("\n")
        assert got == want, (text, cuts)


def _value(draw, deep=0):
    kind = draw.random()
    if deep > 2 or kind < 0.35:
        return draw.choice([1, None, True, "", "a}", "{[", "\\", '"q"', "]}", "é}\n", "\\\\", 'x\\"y}'])
    many = range(draw.randint(0, 3))
    return {draw.choice(["a", "b}", 'c"']): _value(draw, deep + 1) for _ in many} if kind < 0.7 else [_value(draw, deep + 1) for _ in many]


def test_json_cuts_equal_the_whole_file_parser(monkeypatch):
    draw = random.Random(8)
    for _ in range(3000):
        value = [_value(draw) for _ in range(draw.randint(0, 5))] if draw.random() < 0.8 else _value(draw)
        text = draw.choice(["", "\n "]) + json.dumps(value, indent=draw.choice([None, 1]), ensure_ascii=draw.random() < 0.5) + draw.choice(["", "\n"])
        if draw.random() < 0.3:
            k = draw.randrange(len(text))
            text = text[:k] + draw.choice('[]{},"x 1') + text[k + 1 :]
        monkeypatch.setattr(splits, "CHUNK", draw.choice([1, 5, 1 << 22]))
        cuts = sorted({draw.randrange(1, len(text)) for _ in range(draw.randint(0, 6))}) if len(text) > 1 else []
        rows, inside, depth, listed = _cut(text, splits.Json(), cuts)
        try:
            want = json.loads(text)
        except ValueError:
            want = ValueError
        texts = [cells[0] for cells, reason in rows if not reason]
        try:
            sound = len(texts) == len(rows) and not (listed and (inside or depth)) and (all(map(str.strip, texts)) or listed and len(texts) == 1)
            got = [json.loads(t) for t in texts if t.strip()] if sound else ValueError
        except ValueError:
            got = ValueError
        assert got == (want if want is ValueError or isinstance(want, list) else [want]), (text, cuts)


# ---------------------------------------------------------------- splits of Spark


def _csv_text(draw, n):
    out = io.StringIO(newline="")
    rows = csv.writer(out, lineterminator=draw.choice(["\n", "\r\n"]))
    rows.writerow(["name", "other", "email", "company", "name"])
    for i in range(n):
        rows.writerow([f"x{i}", draw.choice(["", 'a "quoted" word', "two\nlines", "é,ü"]), f"p{i}@a.example", draw.choice(["Acme\r\nLtd", "Birch, Inc", ""]), draw.choice([f"P{i}", f'"{i}"'])][: draw.choice([5, 5, 5, 3])])
        if draw.random() < 0.1:
            out.write("\n")
    return out.getvalue()


def test_csv_files_in_many_splits(spark, tmp_path, tiny_splits):
    draw = random.Random(3)
    texts = {"a.csv": _csv_text(draw, 200), "b.CSV": _csv_text(draw, 3), "c.csv": "", "d.csv": "\nname\nx", "e.csv": 'name,email\nq,"open ' + "line\n" * 300, "f.csv": "name\n" + "w" * 5000 + "\nlast"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    cut = splits.csv_rows(splits.pieces(spark, str(tmp_path), "*.[cC][sS][vV]", "\n"), CSV_COLUMN_NAMES)
    got = {(r["file"], r["item"]): {c: r[c] for c in CSV_COLUMN_NAMES} for r in cut.collect()}
    want = {(name, i): {c: row.get(c) for c in CSV_COLUMN_NAMES} for name, text in texts.items() for i, row in enumerate(csv.DictReader(io.StringIO(text, newline="")))}
    assert got == want and len(want) > 200
    assert spark.read.text(str(tmp_path / "a.csv")).rdd.getNumPartitions() > 10


def test_records_too_long_keep_their_number(monkeypatch):
    monkeypatch.setattr(splits, "RECORD_CHARS", 1000)
    text = "name,email\nA,a@x\nB," + "b" * 3000 + '\nC,"' + "c\n" * 900 + '"\nD,d@x\nE,"' + "e\n" * 700
    want = [(["name", "email"], None), (["A", "a@x"], None), (None, "a row of 3003 characters"), (None, "a row of 1805 characters"), (["D", "d@x"], None), (None, "a row of 1403 characters")]
    for cuts in ([], [400, 2500, 4000, 5200], [3100], [12, 30, 4900]):
        assert _cut(text, splits.Csv(), cuts)[0] == want
    items = '[{"a": 1}, {"b": "' + "}" * 2000 + '"}, 3, ["' + "x}" * 700 + '"]]'
    for cuts in ([], [500, 1500, 2300], [2040]):
        rows = _cut(items, splits.Json(), cuts)[0]
        assert [(c and json.loads(c[0]), r and r[:7]) for c, r in rows] == [({"a": 1}, None), (None, "an item"), (3, None), (None, "an item")]


def test_json_files_in_many_splits(spark, tmp_path, tiny_splits):
    draw = random.Random(4)
    values = {f"j{k}.json": [{"ats_id": str(i), "name": draw.choice(["A}", "[B", 'C"', "\\D"]), "x": _value(draw)} for i in range(n)] for k, n in enumerate([0, 1, 5, 300])}
    values |= {"one.json": {"name": "Only } one", "x": ["}" * 900]}, "two.json": {"a": {}}}
    for name, v in values.items():
        (tmp_path / name).write_text(json.dumps(v, indent=draw.choice([None, 2])), encoding="utf-8")
    for name, text in {"x0.json": "[{}", "x1.json": '[{"a": 1} {"b": 2}]', "x2.json": "[{}]]", "x3.json": "[{},]", "x4.json": '[{"a": "}', "x5.json": "  ", "x6.json": "[{}] x", "x7.json": "{", "x8.json": "[{]}", "x9.json": "[1, {}" + " " * 900 + "}]"}.items():
        (tmp_path / name).write_text(text)
    got = splits.json_items(splits.pieces(spark, str(tmp_path), "*.json", "}")).selectExpr("file", "item_no", "to_json(item) as item", "reason").collect()
    wrong = sorted((r["file"], r["item_no"]) for r in got if r["reason"])
    assert wrong == [(f"x{i}.json", -1) for i in range(10)] and all(r["reason"].startswith("not JSON") for r in got if r["reason"])
    found: dict = {}
    for r in sorted((r for r in got if not r["reason"]), key=lambda r: r["item_no"]):
        assert r["item_no"] == len(found.setdefault(r["file"], []))
        found[r["file"]].append(json.loads(r["item"]))
    assert found == {name: v if isinstance(v, list) else [v] for name, v in values.items() if v}


def test_an_export_larger_than_one_value(spark, tmp_path):
    item = '{"ats_id": "%d", "name": "Person %d", "email": "p%d@x.example", "notes": "' + "word } [ " * 110 + '"}'
    with open(tmp_path / "big.json", "w") as f:
        f.write("[")
        for i in range(140_000):
            f.write((",\n" if i else "") + item % (i, i, i))
        f.write("]")
    assert (tmp_path / "big.json").stat().st_size > 140e6
    found = read_folder(spark, str(tmp_path))
    r = found.records.selectExpr("count(*) n", "count(distinct rec_pos) p", "max(full_name) name", "count(distinct source_id) s").first()
    assert (r["n"], r["p"], r["name"], r["s"]) == (140_000, 140_000, "Person 99999", 140_000) and found.errors.isEmpty()


def test_json_kind_of_long_texts(spark, monkeypatch):
    from profusion.sources import files

    monkeypatch.setattr(files, "VARIANT_BYTES", 3)
    rows = [("[{}, 1]", True), ("{}", True), ('{"a": [1]}', True), ("[{}, ", False), ("words", False), ("[", False), ("", False)]
    df = spark.createDataFrame(rows, "text string, want boolean")
    assert [r["got"] for r in df.select(is_json(df["text"]).alias("got")).collect()] == [w for _, w in rows]


# ---------------------------------------------------------------- damaged files, errors


def _docx() -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f"<w:p><w:r><w:t>line {i} of the resume</w:t></w:r></w:p>" for i in range(30))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return data.getvalue()


def test_damaged_documents_never_raise():
    draw, whole = random.Random(5), _docx()
    assert docx_text(whole).startswith("line 0")
    for _ in range(300):
        bad = bytearray(whole)
        for _ in range(draw.randint(1, 6)):
            bad[draw.randrange(len(bad))] = draw.randrange(256)
        bad = bad[: draw.randrange(len(bad))] if draw.random() < 0.3 else bad
        assert docx_text(bytes(bad)) is None or "line" in docx_text(bytes(bad))


def test_errors_have_reasons_and_cost_no_record(spark, tmp_path):
    folder = fixtures.write(tmp_path)
    draw = random.Random(6)
    for i in range(40):
        bad = bytearray(_docx())
        bad[60 + draw.randrange(200)] ^= 0xFF
        (tmp_path / f"k{i}.docx").write_bytes(bytes(bad))
    (tmp_path / "l.json").write_text('[{"name": "Ok One"}, {"email": 5}, {"name": "After"}]')
    (tmp_path / "m.json").write_text("")
    (tmp_path / "n.txt").write_text(" \n")
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "deep.csv").write_text("name\nNobody")
    found = read_folder(spark, folder)
    errors = {(r["file"], r["item"]): (r["source_type"], r["reason"]) for r in found.errors.collect()}
    names = [r["full_name"] for r in found.records.orderBy("rec_pos").collect()]
    docs = {k[0] for k in errors if k[0].endswith(".docx")}
    assert docs and all(errors[f, 0] == ("resume", "a damaged document, or one that cannot be read") for f in docs)
    assert len(names) == 9 + 40 - len(docs) and "Ok One" in names and "After" not in names and "Nobody" not in names
    rest = {k: v for k, v in errors.items() if k[0] not in docs}
    assert rest == {
        ("e.pdf", 0): ("resume", "a damaged document, or one that cannot be read"), ("g.md", None): (None, "no known kind of file"), ("h.json", -1): ("ats_json", "not JSON: it ends too early"),
        ("l.json", 1): ("ats_json", "the e-mail is no text"), ("l.json", 2): ("ats_json", "it follows an item that cannot be read"),
        ("n.txt", 0): ("resume", "no text"),
    }


def test_rows_and_folders_give_the_same_records(spark, tmp_path, tiny_splits):
    text = _csv_text(random.Random(9), 60)
    (tmp_path / "a.csv").write_bytes(text.encode())
    rows = recruiter_csv(spark.createDataFrame([("a.csv", text)], "file string, text string")).drop("file", "item").collect()
    got = read_folder(spark, str(tmp_path)).records.drop("rec_pos").collect()
    assert sorted(map(str, rows)) == sorted(map(str, got))


def test_a_field_of_any_length_is_read(spark):
    text = "name,company\nA,x\nB," + "long " * 40_000 + "\nC,z\n"
    got = recruiter_csv(spark.createDataFrame([("f.csv", text)], "file string, text string"))
    assert sorted(r["full_name"] for r in got.collect()) == ["A", "B", "C"]
