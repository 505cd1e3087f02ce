"""The array reader at every split size against a parse of the whole document."""

import json
import random

import pytest

from quillon.sources import json_lists, trackers

NAMES = trackers.ENVELOPES
SPLIT = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def split_size(spark):
    before = spark.conf.get(SPLIT)
    yield lambda n: spark.conf.set(SPLIT, str(n))
    spark.conf.set(SPLIT, before)


def value(rng, depth=0):
    kind = rng.randrange(8 if depth < 3 else 4)
    if kind < 2:
        return "".join(rng.choices('ab"\\{}[],: \n\'é ', k=rng.randrange(12)))
    if kind < 4:
        return rng.choice([None, True, -1.5e3, 0, 12])
    if kind < 6:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {f"k{k}": value(rng, depth + 1) for k in range(rng.randrange(4))}


def documents(seed, n=60):
    rng = random.Random(seed)
    return [{"id": str(k), "v": value(rng)} for k in range(n)]


def read(spark, path):
    rows = json_lists.split_objects(spark, path, NAMES)
    return rows if rows is None else sorted((json.loads(r.raw) for r in rows.collect()), key=lambda o: int(o["id"]))


@pytest.mark.parametrize("wrap", ["plain", "envelope", "spaced"])
def test_random_nesting_at_every_split_size(spark, tmp_path, split_size, wrap):
    given = documents(11)
    text = {"plain": json.dumps(given), "envelope": json.dumps({"items": given, "total": 60, "next": 'a"]'}), "spaced": "\n " + json.dumps(given, indent=3, ensure_ascii=False) + "\n\n"}[wrap]
    path = tmp_path / "list.json"
    path.write_text(text)
    for size in (37, 500, 1 << 20):
        split_size(size)
        assert read(spark, str(path)) == given


def test_many_tasks_for_one_document(spark, tmp_path, split_size):
    given = [{"id": str(k), "text": f'a "}}" of {k} ' * 20} for k in range(5000)]
    path = tmp_path / "list.json"
    path.write_text(json.dumps(given))
    split_size(200_000)
    assert json_lists.pieces(spark, str(path)).rdd.getNumPartitions() > 4
    assert read(spark, str(path)) == given


@pytest.mark.parametrize(
    "text",
    [
        "", "[]", "7", "[1, 2]", '[{"id":"1"}, 5]', '[{"id":"1"} {"id":"2"}]', '[{"id":"1"},]', '[{"id":"1"}', '[{"id":"1"}] x', "[{'id':'1'}]", '{"x":1,"items":[{"id":"1"}]}',
        '{"items":[{"id":"1"}],"data":[]}', '{"items":[{"id":"1"}],"m":{"n":[{"id":"2"}]}}', '{"items":[],"m":[{"id":"2"}]}', '{"other":[{"id":"1"}]}', '[{"id":"1"},{"id":"2","s":"x}]',
    ],
)
def test_other_layouts_are_left(spark, tmp_path, text):
    path = tmp_path / "list.json"
    path.write_text(text)
    assert read(spark, str(path)) is None


def test_records_of_a_split_list_equal_those_of_a_whole_one(spark, tmp_path, split_size):
    path = tmp_path / "list.json"
    rows = [{"id": f"r{k}", "title": f"T {{{k}}}", "status": "open", "labels": [{"name": "x"}], "dependencies": [f"r{k + 1}"]} for k in range(40)]
    path.write_text(json.dumps({"issues": rows}, indent=1))
    split_size(300)
    whole, cut = (trackers.TrackerFiles(spark, str(path), whole_bytes=n).records().orderBy("id").collect() for n in (1 << 30, 0))
    assert whole == cut and len(cut) == 40
    path.write_text(json.dumps([*rows, rows[3]]))
    with pytest.raises(trackers.SourceError):
        trackers.TrackerFiles(spark, str(path), whole_bytes=0).records()
    path.write_text(json.dumps([rows[0], 7]))
    with pytest.raises(Exception):
        trackers.TrackerFiles(spark, str(path), whole_bytes=0).records().collect()
