import json

import pytest
from codeweave.plans import extraction as E


def test_passes_take_up_where_they_stood(spark, tmp_path):
    root = str(tmp_path)
    counts = spark.createDataFrame([("ON", 10), ("BC", 0)], "province string, n int")
    E.read_missing_pages(spark, root, counts, lambda p, numbers: [f"{p} page {n} K{n:03d}" for n in numbers])
    E.read_missing_pages(spark, root, counts, lambda p, numbers: 1 / 0)
    assert spark.read.parquet(f"{root}/ocr_pages").count() == 10

    def first(prompt):
        if "page 0 " in prompt:
            return "no json"
        return json.dumps({"chapter": "C", "codes": [{"fsc_code": w} for w in prompt.split() if w.startswith("K")]})

    E.extract_missing_windows(spark, root, first)
    E.extract_missing_windows(spark, root, lambda prompt: 1 / 0)
    assert {(r.start, r.status) for r in spark.read.parquet(f"{root}/done_windows").collect()} == {(0, "done"), (6, "done")}
    assert [(r.start, r.hints) for r in E.windows_to_repair(spark, root, 5).collect()] == [(0, 8)]
    assert E.repair(spark, root, lambda prompt: json.dumps({"codes": [{"fsc_code": " k001"}, {"fsc_code": "K007"}]}), 5) == 1
    assert E.repair(spark, root, lambda prompt: 1 / 0, 5) == 0
    got = {(r.fsc_code, r.page_start) for r in E.codes(spark, root).collect()}
    assert got == {("K001", 0), ("K007", 0), ("K006", 6), ("K008", 6), ("K009", 6)}


def test_a_run_that_is_killed_repeats_one_batch(spark, tmp_path):
    import os

    root, calls = str(tmp_path / "root"), str(tmp_path / "calls")
    counts = spark.createDataFrame([("ON", 30)], "province string, n int")
    E.read_missing_pages(spark, root, counts, lambda p, numbers: [f"K{n:03d}" for n in numbers], batch=2)
    assert spark.read.parquet(f"{root}/ocr_pages").count() == 30

    def extract(prompt, dies=True):
        if dies and "K018" in prompt and "K012" not in prompt:
            os._exit(1)
        with open(calls, "a") as f:
            f.write(prompt.split()[0] + "\n")
        return json.dumps({"codes": [{"fsc_code": w} for w in prompt.split() if w.startswith("K")]})

    with pytest.raises(Exception, match="Python worker"):
        E.extract_missing_windows(spark, root, extract, batch=2)
    kept = {r.start for r in spark.read.parquet(f"{root}/done_windows").collect()}
    assert kept == {0, 6}
    E.extract_missing_windows(spark, root, lambda p: extract(p, dies=False), batch=2)
    with open(calls) as f:
        asked = f.read().split()
    assert asked.count("K000") == asked.count("K006") == 1
    assert {r.start for r in spark.read.parquet(f"{root}/done_windows").filter("status = 'done'").collect()} == {0, 6, 12, 18, 24}
    assert E.codes(spark, root).count() == 30


def test_failed_windows_are_tried_again(spark, tmp_path, monkeypatch):
    from codeweave.sources import clients

    monkeypatch.setattr(clients, "with_retries", lambda call: call)
    root = str(tmp_path)
    E.read_missing_pages(spark, root, spark.createDataFrame([("ON", 2)], "province string, n int"), lambda p, numbers: ["K1 K2" for _ in numbers])
    E.extract_missing_windows(spark, root, lambda prompt: 1 / 0)
    assert [r.status for r in spark.read.parquet(f"{root}/done_windows").collect()] == ["failed"]
    E.extract_missing_windows(spark, root, lambda prompt: json.dumps({"codes": [{"fsc_code": "K1"}]}))
    E.extract_missing_windows(spark, root, lambda prompt: 1 / 0)
    assert sorted(r.status for r in spark.read.parquet(f"{root}/done_windows").collect()) == ["done", "failed"]


def windows(spark, root, texts, **counts):
    E.read_missing_pages(spark, root, spark.createDataFrame([("ON", len(texts))], "province string, n int"), lambda p, numbers: [texts[n] for n in numbers])


def counted(path, answer):
    def call(prompt):
        with open(path, "a") as f:
            f.write(prompt.replace("\n", " ") + "\n")
        return answer(prompt)

    return call


def calls(path):
    try:
        with open(path) as f:
            return f.read().splitlines()
    except FileNotFoundError:
        return []


def test_blank_windows_are_done_without_a_call_and_empty_ones_are_repaired_once(spark, tmp_path):
    """Three plain runs: a window of blanks costs nothing, one that stays empty one call and one repair."""
    root, path = str(tmp_path / "root"), str(tmp_path / "calls")
    windows(spark, root, ["K001 K002 K003"] * 8 + [" \u00a0\n", ""] * 4)
    for run in range(3):
        E.extract_missing_windows(spark, root, counted(path, lambda p: "{}"))
        E.repair(spark, root, counted(path, lambda p: "{}"), 3)
        assert len(calls(path)) == 4, run
    done = spark.read.parquet(f"{root}/done_windows").collect()
    assert sorted((r.start, r.kind, r.status) for r in done) == [(0, "first", "done"), (0, "repair", "done"), (6, "first", "done"), (6, "repair", "done"), (12, "first", "done")]
    assert all("K003  ---PAGE BREAK---  K001" in c for c in calls(path)[:1])


class Stop(Exception):
    pass


@pytest.mark.parametrize("where", ["before", "after write", "after rename"])
def test_a_kill_between_any_two_writes(spark, tmp_path, monkeypatch, where):
    """Before a batch is renamed, after, or before the next pass: no double codes and no second call for what was written whole."""
    from codeweave.plans.commits import CommitLog

    root, path = str(tmp_path / "root"), str(tmp_path / "calls")
    windows(spark, root, [f"K{n:03d}" for n in range(20)])
    answer = lambda p: json.dumps({"codes": [{"fsc_code": w} for w in p.split() if w.startswith("K0")]})
    plain, seen = CommitLog._publish, []

    def dying(self, name):
        seen.append(name)
        if len(seen) == 2 and where == "before":
            self._fs.delete(self._path(f"{self.folder}/_pending/{name}/_SUCCESS"), False)
        if len(seen) == 2 and where != "after rename":
            raise Stop
        plain(self, name)
        if len(seen) == 2:
            raise Stop

    monkeypatch.setattr(CommitLog, "_publish", dying)
    with pytest.raises(Stop):
        E.extract_missing_windows(spark, root, counted(path, answer), batch=1)
    before = len(calls(path))
    assert before == 2
    monkeypatch.setattr(CommitLog, "_publish", plain)
    E.extract_missing_windows(spark, root, counted(path, answer), batch=1)
    assert len(calls(path)) == (5 if where == "before" else 4)
    assert E.codes(spark, root).count() == 20 and spark.read.parquet(f"{root}/raw_codes").count() == E.raw_codes(spark, root).count()
    assert spark.read.parquet(f"{root}/done_windows").groupBy("start").count().filter("count > 1").count() == 0


def test_four_tasks_stay_under_a_rate(spark, tmp_path):
    import time

    from codeweave.sources import clients

    path = str(tmp_path / "times")

    def call(prompt):
        with open(path, "a") as f:
            f.write(f"{time.time()}\n")
        return "{}"

    texts = spark.createDataFrame([("ON", i, f"text {i}") for i in range(40)], "province string, start int, text string").repartition(9)
    assert clients.extract_windows(texts, call, lanes=4, rate=20.0).count() == 40
    times = sorted(float(x) for x in calls(path))
    assert len(times) == 40
    for i in range(len(times)):
        assert sum(times[i] <= t < times[i] + 1 for t in times) <= 20 + 4
    assert times[-1] - times[0] > 1.5


def test_signed_addresses_are_renewed(spark, tmp_path):
    from codeweave.sources import clients

    path = str(tmp_path / "signed")

    def sign(province):
        with open(path, "a") as f:
            f.write(province + "\n")
        return f"{province}?{len(calls(path))}"

    todo = spark.createDataFrame([("ON", i) for i in range(40)], "province string, page int")
    got = clients.read_pages(todo, lambda address, numbers: [address] * len(numbers), at_once=4, lanes=1, rate=1000.0, sign=sign, signed_for=4).collect()
    assert len(calls(path)) == 3 and {r.markdown for r in got} == {"ON?1", "ON?2", "ON?3"} and len(got) == 40


def test_pause_between_calls():
    from codeweave.sources import clients

    clock, slept = [0.0], []

    def sleep(s):
        slept.append(round(s, 6))
        clock[0] += s

    call = clients.paced(lambda cost: clock.__setitem__(0, clock[0] + cost), 1.0, lambda: clock[0], sleep)
    for cost in (0.4, 2.0, 0.0):
        call(cost)
    assert slept == [0.0, 0.6, 0.0]
