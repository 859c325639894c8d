"""The change feed: cursors by source, restarts in the middle of a batch, removals."""

import json
import random

import pytest
from pyspark.errors import StreamingQueryException

from colloquy.streaming import changes as C


def page(root, source, cursor, *items):
    place = root / f"source={source}" / f"cursor={cursor}"
    place.mkdir(parents=True)
    half = len(items) // 2
    for name, own in (("part-0", items[:half]), ("part-1", items[half:])):
        (place / name).write_text("".join(json.dumps({"file_id": i, "removed": gone, "checksum": f"{cursor}-{i}"}) + "\n" for i, gone in own))


def files(spark, log):
    return sorted((r.source, r.file_id, r.cursor) for r in C.current_files(C.change_log(spark, log).read("changes")).collect())


def lost():
    raise RuntimeError("lost")


@pytest.mark.parametrize("when", ["before_publish", "after_publish"])
def test_a_restart_in_the_middle_registers_each_change_once(spark, tmp_path, when):
    root, log, checkpoint = tmp_path / "feed", str(tmp_path / "log"), str(tmp_path / "ck")
    page(root, "a", "001", ("f1", False), ("f2", False))
    page(root, "a", "002", ("f1", False), ("f3", False), ("f3", True))
    page(root, "b", "007", ("f1", False))
    with pytest.raises(StreamingQueryException):
        C.follow_changes(spark, str(root), log, checkpoint, **{when: lost})
    page(root, "a", "003", ("f2", True), ("f4", False))  # comes while the job is down
    page(root, "c", "001", ("x", False))
    for _ in range(2):
        C.follow_changes(spark, str(root), log, checkpoint)
        assert C.change_log(spark, log).read("changes").count() == 9
        assert files(spark, log) == [("a", "f1", "002"), ("a", "f4", "003"), ("b", "f1", "007"), ("c", "x", "001")]
    page(root, "b", "008", ("f1", True))
    C.follow_changes(spark, str(root), log, checkpoint)
    C.follow_changes(spark, str(root), log, f"{checkpoint}-lost")  # all offsets gone: every page comes again
    assert C.change_log(spark, log).read("changes").count() == 10
    assert files(spark, log) == [("a", "f1", "002"), ("a", "f4", "003"), ("c", "x", "001")]


def test_offsets_and_pages(tmp_path):
    page(tmp_path, "a", "1", ("f", False))
    page(tmp_path, "a", "2", ("f", False))
    page(tmp_path, "b", "5", ("f", False))
    reader = C.ChangeReader("folder", str(tmp_path))
    assert reader.initialOffset() == {} and reader.latestOffset() == {"a": "2", "b": "5"}
    pages = lambda a, b: [(p.source, p.cursor) for p in reader.partitions(a, b)]
    assert pages({}, {"a": "2", "b": "5"}) == [("a", "1"), ("a", "2"), ("b", "5")]
    assert pages({"a": "1"}, {"a": "2", "b": "5"}) == [("a", "2"), ("b", "5")] and pages({"a": "2", "b": "5"}, {"a": "2", "b": "5"}) == []
    assert C.ChangeReader("folder", str(tmp_path / "none")).latestOffset() == {}


def test_current_files_equal_a_plain_fold(spark):
    draw, rows = random.Random(2), []
    for cursor in range(6):
        for position in range(20):
            rows.append((draw.choice("ab"), str(cursor), position, f"f{draw.randrange(9)}", draw.choice([True, False, False, None])))
    want = {}
    for s, c, p, f, gone in rows:
        want.pop((s, f), None)
        if not gone:
            want[s, f] = (c, p)
    draw.shuffle(rows)
    table = spark.createDataFrame([(*r, None, None, None, None) for r in rows], C.CHANGE)
    assert {(r.source, r.file_id): (r.cursor, r.position) for r in C.current_files(table).collect()} == want
    assert C.current_files(table.limit(0)).count() == 0
