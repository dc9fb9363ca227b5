"""JSON files that many tasks read give the records of the whole file."""

import json
import random

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from deskloom import lexicon as lx
from deskloom.operators.normalise import normalise_tickets
from deskloom.sources import json_split
from deskloom.sources.corpus import load_articles
from deskloom.sources.tickets import read_records

NASTY = ['a } b', '{"x": [1, 2]}', 'quote " here', "back \\ slash \\", '\\"}],[{', "é 日本 😀 }", "", "line\nbreak", "],", "}}}}", '"', "tickets"]


@pytest.fixture
def small_blocks(spark):
    """Splits of some dozen bytes, so that strings, escapes and records cross them at every place."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def use(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "1")

    yield use
    for name, value in before.items():
        spark.conf.set(name, value)


def a_record(rnd, k):
    out = {"ticket_id": f"T-{k}", "subject": rnd.choice(NASTY), "body": rnd.choice(NASTY) * rnd.randrange(3)}
    if rnd.random() < 0.5:
        out["labels"] = {"intent": rnd.choice(NASTY), "deep": [{"a": [1, {"b": rnd.choice(NASTY)}]}]}
    if rnd.random() < 0.3:
        out["attachments"] = [rnd.choice(NASTY), "x"]
    return out


def plain(text):
    """Records of a file's text by a whole parse."""
    try:
        value = json.loads(text)
    except ValueError:
        out = []
        for line in filter(None, map(str.strip, text.splitlines())):
            try:
                out.append(json.loads(line))
            except ValueError:
                out.append({"body": line})
        return out
    if isinstance(value, list):
        return value
    if isinstance(value, dict):
        for name in lx.TICKET_WRAPPERS:
            if isinstance(value.get(name), list):
                return value[name]
        if value and all(isinstance(v, dict) for v in value.values()):
            return [{**v, "ticket_id": v.get("ticket_id", k)} for k, v in value.items()]
    return [value]


def files(rnd):
    records = [a_record(rnd, k) for k in range(8)]
    dump = lambda v: json.dumps(v, indent=rnd.choice([None, 1, 2]), ensure_ascii=rnd.random() < 0.5)
    keyed = {rnd.choice(NASTY) + str(k): {f: v for f, v in r.items() if f != "ticket_id"} for k, r in enumerate(records)}
    return {
        "list": dump(records), "padded": "\n  " + dump(records) + " \n\n", "mixed": dump([1, "two }", None, [3, {"a": 4}], records[0], {}]),
        "wrapped": dump({"meta": {"n": 1, "list": [1, {"tickets": [2]}]}, "tickets": records, "after": [{"z": 1}]}),
        "two": dump({"items": records[:3], "tickets": records[3:], "data": "no list"}), "empty_list": "[ ]",
        "empty_wrapper": dump({"tickets": [], "a": {"b": 1}}), "keyed": dump(keyed), "single": dump(records[0] | {"x": {"y": "}"}}),
        "empty_object": "{}", "lines": "\n".join(json.dumps(r) for r in records) + "\n\nplain } text\n{\"cut\": ",
        "cut": dump({"tickets": records})[:-1], "cut_list": dump(records)[:-3], "more": dump(records[:2]) + ' {"x": 1}', "extra": dump(records[:2]) + "]",
        "one_line": json.dumps(records[1]), "word": "just words", "number": "12", "no_brace": "[1, 2, 3]", "empty": "",
    }


def cut_in_python(text, rnd, wrappers=lx.TICKET_WRAPPERS):
    """Kind and pieces of one file whose blocks end at some of its closing braces."""
    values = text.split("}")
    values = values[:-1] if values[-1] == "" else values
    block, rows = 0, []
    for k, value in enumerate(values):
        rows.append(("f", block, len(text.encode()), value.encode()))
        block += rnd.random() < 0.4

    def batches(columns, rows, kinds):
        for part in ([r for r in rows if r[1] <= block // 2], [r for r in rows if r[1] > block // 2]):
            if part:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part), kinds)], names=columns)

    kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary()]
    summaries = pd.concat(b.to_pandas() for b in json_split._summaries(batches(["path", "block", "size", "value"], rows, kinds)))
    states = {r.block: tuple(r)[2:] for r in json_split._states(summaries).itertuples(index=False)}
    stated = [(*r, *states[r[1]]) for r in rows]
    names = ["path", "block", "size", "value", "inside", "depth", "key", "listed", "kind"]
    kinds += [pa.bool_(), pa.int32(), pa.string(), pa.bool_(), pa.string()]
    pieces = pd.concat(b.to_pandas() for b in json_split._pieces(wrappers)(batches(names, stated, kinds)))
    parts = pieces[pieces.part.isin(["head", "middle", "tail"])]
    joined = json_split._joined(parts) if len(parts) else parts
    whole = pd.concat([pieces[pieces.part == "whole"], joined]).sort_values(["block", "seq"])
    return states[0][-1], whole, set(pieces.part), block


def test_elements_wherever_blocks_end():
    rnd = random.Random(7)
    for _ in range(12):
        for name, text in files(rnd).items():
            kind, whole, seen, _ = cut_in_python(text, rnd) if text else ("lines", None, set(), 0)
            try:
                value = json.loads(text)
            except ValueError:
                value = None
            if not isinstance(value, (list, dict)):
                assert kind == "lines" or "more" in seen, name
                continue
            assert kind == ("list" if isinstance(value, list) else "object") and "more" not in seen, name
            if kind == "list":
                assert [json.loads(t) for t in whole.text] == value, name
                continue
            for key in lx.TICKET_WRAPPERS:
                if isinstance(value.get(key), list):
                    assert [json.loads(t) for t in whole[whole.key == key].text] == value[key], name
            entries = [t for t in whole[whole.key.isna()].text if t.strip()]
            rest = {k: v for k, v in value.items() if not (k in lx.TICKET_WRAPPERS and isinstance(v, list))}
            assert json.loads("{" + ",".join(entries) + "}") == rest, name


@pytest.mark.parametrize("size", [301, 1 << 20])
def test_every_shape_through_spark(spark, tmp_path, small_blocks, size):
    made = files(random.Random(size))
    for name, text in made.items():
        (tmp_path / f"{name}.json").write_text(text)
    small_blocks(size)
    rows = sorted(read_records(spark, str(tmp_path)).select("path", "position", "record_text").collect())
    assert len({r.position for r in rows}) == len(rows)
    got = {}
    for r in rows:
        name = r.path.rsplit("/", 1)[1].removesuffix(".json")
        got.setdefault(name, []).append(json.loads(r.record_text, strict=False))
    for name, text in made.items():
        assert got.get(name, []) == plain(text), name


def test_states_too_many_to_broadcast(spark, tmp_path, small_blocks, monkeypatch):
    monkeypatch.setattr(json_split, "BROADCAST_ROWS", 0)
    text = files(random.Random(5))["wrapped"]
    (tmp_path / "f.json").write_text(text)
    small_blocks(150)
    rows = sorted(read_records(spark, str(tmp_path / "f.json")).select("position", "record_text").collect())
    assert [json.loads(r.record_text) for r in rows] == plain(text)
    assert [r.position for r in rows] == list(range(8))


def test_one_file_is_read_by_many_tasks(spark, tmp_path, small_blocks):
    records = [{"ticket_id": f"T-{k}", "body": f"text {k} " + "x } y " * 20} for k in range(400)]
    (tmp_path / "f.json").write_text(json.dumps(records))
    whole = {r.ticket_id: r.body for r in normalise_tickets(read_records(spark, str(tmp_path / "f.json"))).collect()}
    small_blocks(4000)
    scan = spark.read.option("lineSep", "}").text(str(tmp_path / "f.json"))
    tasks, total = scan.rdd.getNumPartitions(), (tmp_path / "f.json").stat().st_size
    largest = max(scan.groupBy(F.spark_partition_id()).agg(F.sum(F.length("value"))).toPandas().iloc[:, 1])
    assert tasks > 10 and largest < total / 8
    split = {r.ticket_id: r.body for r in normalise_tickets(read_records(spark, str(tmp_path / "f.json"))).collect()}
    assert split == whole and len(split) == 400


def test_articles_at_every_split(spark, tmp_path, small_blocks):
    articles = [{"doc_id": f"d{k}", "title": f"T {k} }}", "sections": [{"heading": "h }", "content": '"]}' * k}]} for k in range(9)]
    (tmp_path / "list.json").write_text(json.dumps({"articles": articles}))
    (tmp_path / "keyed.json").write_text(json.dumps({"k1": {"title": "}", "content": "c"}, "k2": "plain } content"}))
    whole = sorted(map(tuple, load_articles(spark, str(tmp_path)).collect()))
    small_blocks(151)
    assert sorted(map(tuple, load_articles(spark, str(tmp_path)).collect())) == whole
    assert [r[1] for r in whole] == ["k1", "k2", *[f"d{k}" for k in range(9)]]
