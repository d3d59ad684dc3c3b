"""Activity from file times and a log with broken lines."""

from __future__ import annotations

import os

from foliant.operators import activity
from foliant.sources import files


def test_files_and_log_by_day(spark, tmp_path):
    day = {"old": 1_700_000_000, "new": 1_700_000_000 + 86_400}
    for name, when in (("Papers/a/a.md", "old"), ("Papers/a/a.我的笔记.md", "old"), ("Topics/t.md", "new"), ("Papers/.obsidian/x.json", "new"), ("30_Terms/_生词.json", "new")):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x")
        os.utime(path, (day[when], day[when]))
    log = tmp_path / "log.jsonl"
    log.write_text('{"date": "2023-11-14T08:00", "type": "note"}\n\nbroken {\n{"date": "2023-11-15"}\n{"type": "vocab"}\n{"date": ""}\n')
    rows = files.json_log(spark, str(log))
    assert rows.count() == 5 and [r.bad for r in rows.where("bad is not null").collect()] == ["broken {"]
    found = files.whole_listing(spark, f"{tmp_path}/Papers").union(files.whole_listing(spark, f"{tmp_path}/Topics")).union(files.whole_listing(spark, f"{tmp_path}/30_Terms"))
    got = {r.day: (r.mine, r.ai) for r in activity.collected(found, rows).collect()}
    assert got == {"2023-11-14": (2, 1), "2023-11-15": (2, 1)}
    # a missing log or folder is an empty one
    assert files.whole_listing(spark, f"{tmp_path}/none").count() == 0
    assert files.json_log(spark, f"{tmp_path}/none.jsonl").count() == 0
