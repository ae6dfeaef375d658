"""The store of days with fallbacks."""

import json

import pytest

from matchmill.sources.daystore import read_days


def test_read_days(spark, tmp_path):
    """The first place lacks a day, the second has a corrupt one, shapes differ, and no day mixes two places."""
    a, b, c = (tmp_path / x for x in "abc")
    for p in (a, b, c):
        p.mkdir()
    row = lambda i, s, **more: {"id": i, "status": s, **more}
    (a / "2024-01-01.json").write_text(json.dumps([row("1", "FT", goals=3, odds="2.5", live=True), row(2, None, goals="x")]))
    (b / "2024-01-01.json").write_text(json.dumps([row("9", "NS")]))
    (b / "2024-01-02.json").write_text('{"events": [{"id": "3", "status": "FT"')
    (c / "2024-01-02.json").write_text(json.dumps({"data": [row("3", "NS", extra={"k": 1})]}))
    (b / "2024-01-03.json").write_text(json.dumps({"matches": [row("4", "FT")]}))
    (c / "2024-01-03.json").write_text(json.dumps([row("5", "FT"), row("6", "FT")]))
    (a / "2024-01-04.json").write_text("[1, 2]")
    (a / "2024-01-05.json").write_text("[]")
    (c / "2024-01-05.json").write_text(json.dumps([row("7", "FT")]))
    places = [f"file://{p}" for p in (a, b, tmp_path / "absent", c)]
    schema = "day string, place int, id string, status string, goals long, odds double, live boolean, extra string"
    got = sorted(map(tuple, read_days(spark, places, schema).collect()))
    assert got == [
        ("2024-01-01", 0, "1", "FT", 3, 2.5, True, None), ("2024-01-01", 0, "2", None, None, None, None, None),
        ("2024-01-02", 3, "3", "NS", None, None, None, '{"k": 1}'), ("2024-01-03", 1, "4", "FT", None, None, None, None),
    ]
    assert read_days(spark, places, schema).rdd.getNumPartitions() == 5
    assert read_days(spark, [f"file://{tmp_path}/absent"], schema).count() == 0
    with pytest.raises(Exception, match="2024-01-04"):
        read_days(spark, places, schema, strict=True).count()
