"""Sinks, readiness checks, model shelf, image measures, page documents and the job service."""

import logging
import math
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_run import BAD, GOOD, repairing_engine

from leafgrade import images, models, pipeline, readiness, service, sinks, sources
from leafgrade.cli import main
from leafgrade.config import EnvironmentProblems, LeafgradeError, MissingDependencyError, RunConfig
from leafgrade.events import Teller, to_log
from leafgrade.operators import coverage
from leafgrade.operators.ranking import placed


@pytest.fixture
def folder(tmp_path):
    for name in ("in/a", "in/b"):
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "x.txt").write_text(f"{GOOD} {name}\f{BAD}")
    (tmp_path / "in" / "Y.TXT").write_text(GOOD)
    (tmp_path / "words.txt").write_text("\n".join(set(GOOD.lower().replace(".", "").split())))
    return tmp_path


def words(spark, folder):
    return sources.word_list(spark, f"file://{folder}/words.txt")


def config(folder, name, **more):
    return RunConfig(f"file://{folder}/in", f"file://{folder}/{name}", recursive=True, **more)


def test_files_of_one_name_stay_apart(spark, folder):
    files, pages = pipeline.run(spark, config(folder, "out", extract_text=True, diagnostics=True, copy_sources=True), words(spark, folder))
    assert files.count() == 2 and pages.count() == 4
    texts = {r.stem: r.value for r in spark.read.text(f"file://{folder}/out/final", wholetext=True).collect()}
    assert len(texts) == 2 and all(s.startswith("x-") for s in texts)
    assert sorted("in/a" in t for t in texts.values()) == [False, True]
    assert spark.read.text(f"file://{folder}/out/diagnostics").count() == 2
    assert len(os.listdir(f"{folder}/out/copies")) == 2
    assert not os.path.exists(f"{folder}/out/work")
    r = files.first()
    assert r.output_path and r.time_seconds >= 0 and "analysis" in r.phase_seconds and r.paragraph_joins is not None


def test_intermediates_stay_on_request(spark, folder):
    pipeline.run(spark, config(folder, "kept", keep_intermediates=True), words(spark, folder))
    assert {"raw", "scored"} <= set(os.listdir(f"{folder}/kept/work"))


def test_first_engine_reads_bad_files_again(spark, folder):
    (folder / "in" / "c.txt").write_text(GOOD)
    (folder / "in" / "d.txt").write_text(BAD + "stop")

    def engine(content):
        if b"stop" in content:
            raise ValueError("cannot")
        return [(GOOD, None)]

    files, pages = pipeline.run(spark, config(folder, "first"), words(spark, folder), first_engine=engine)
    got = {r.path.rsplit("/in/", 1)[1]: (r.engine, r.flagged_pages, r.page_count, r.success) for r in files.collect()}
    assert got == {"a/x.txt": ("tesseract", 0, 1, True), "b/x.txt": ("tesseract", 0, 1, True), "c.txt": ("existing", 0, 1, True), "d.txt": ("none", 0, 0, False)}
    forced, _ = pipeline.run(spark, config(folder, "forced", force_first=True), words(spark, folder), first_engine=engine)
    assert {r.engine for r in forced.collect()} == {"tesseract", "none"}


def test_confidences_count_in_a_run(spark, folder):
    def reader(content):
        return [(GOOD, [("word", 10)] * 50), (GOOD, [("word", 98)] * 50), (GOOD, None), (GOOD, [])]

    _, pages = pipeline.run(spark, config(folder, "conf", files=["x.txt"]), words(spark, folder), reader)
    got = {r.page_number: r for r in pages.where(F.col("path").contains("/a/")).collect()}
    assert got[0].score <= 0.3 and got[0].flagged and got[0].confidence_score == pytest.approx(0.1)
    assert got[1].score >= 0.9 and got[2].confidence_score is None and got[3].confidence_score == 0.5
    assert len(got[0].disagreements) == 3 and len(got[2].disagreements) == 1


def test_events_of_a_run(spark, folder):
    told = []

    def broken(event):
        raise RuntimeError("receiver")

    pipeline.run(spark, config(folder, "events", files=["x.txt", "z.txt"]), words(spark, folder), make_engine=repairing_engine, receivers=[broken, told.append])
    seen = [(e.stage, e.what) for e in told]
    assert seen == [("discovery", "missing"), ("analysis", "started"), ("analysis", "finished"), ("second engine", "started"), ("second engine", "loaded"), ("second engine", "finished"), ("run", "finished")]
    assert told[2].figures == {"files": 2, "pages": 4, "flagged": 2} and told[5].figures["failed"] == 0


def test_events_reach_a_log(caplog):
    with caplog.at_level(logging.INFO, "leafgrade"):
        Teller(to_log())("stage", "counted", pages=3)
    assert "stage counted pages=3" in caplog.text


def test_a_suffix_counts_in_any_case(spark, folder):
    found, missing = sources.discovered(spark, f"file://{folder}/in", "*.txt", False, ["Y.TXT", "no.txt"])
    assert found.count() == 1 and missing == ["no.txt"]


def test_exit_codes(spark, folder, monkeypatch, capsys):
    vocabulary = ["--vocabulary", f"file://{folder}/words.txt"]
    assert main([f"file://{folder}/in", f"file://{folder}/cli", *vocabulary, "--recursive", "--debug", "--samples", "3"]) == 0
    assert "time" in capsys.readouterr().out
    assert main([f"file://{folder}/in", f"file://{folder}/cli", *vocabulary, "--languages", "xx"]) == 1
    assert main([f"file://{folder}/in", f"file://{folder}/cli", *vocabulary, "--threshold", "7"]) == 1

    def interrupted(*a, **k):
        raise KeyboardInterrupt

    monkeypatch.setattr("leafgrade.cli.run", interrupted)
    assert main([f"file://{folder}/in", f"file://{folder}/cli", *vocabulary]) == 130


def test_all_problems_are_told(spark, tmp_path):
    needs = readiness.Needs(programs=("no-such-program",), modules=("no_such_module",), languages=("eng", "xyz"), list_languages=("printf", "list:\\neng\\n"), folder=str(tmp_path / "gone"))
    with pytest.raises(EnvironmentProblems) as e:
        readiness.validate(needs)
    assert len(e.value.problems) == 4 and "xyz" in str(e.value)
    assert {r.problem for r in readiness.check_executors(spark, needs, 4).collect()} == set(e.value.problems)
    assert readiness.check_executors(spark, readiness.Needs(), 4).count() == 0
    with pytest.raises(MissingDependencyError):
        readiness.require("no_such_module")
    assert readiness.version_of("no-such-program") == "unknown" and readiness.has_module("numpy")


@pytest.mark.parametrize("cuda,mps,want", [(True, True, ("cuda", None)), (False, True, ("mps", "cuda")), (None, True, ("mps", None)), (None, False, ("cpu", "mps")), (False, False, ("cpu", "cuda")), (None, None, ("cpu", None))])
def test_devices_in_order(cuda, mps, want):
    probes = {"cuda": lambda: cuda, "mps": lambda: mps}
    d = readiness.choose_device(probes)
    assert (d.name, d.instead_of) == want and readiness.device_status(d)
    if d.instead_of:
        with pytest.raises(EnvironmentProblems):
            readiness.choose_device(probes, strict=True)


def test_memory():
    assert readiness.memory_gb() > 0.1 and readiness.memory_gb("cuda") == readiness.memory_gb()
    assert readiness.memory_report()["process_mb"] > 1


def test_models_expire(monkeypatch):
    now, loads = [0.0], []
    s = models.Shelf(10, clock=lambda: now[0])
    load = lambda: loads.append(1) or "model"
    assert s.get("m", load)[0] == "model" and s.get("m", load) == ("model", 0.0) and len(loads) == 1
    now[0] = 9
    s.get("m", load)
    now[0] = 18
    assert s.loaded()
    now[0] = 30
    assert not s.loaded() and s.get("m", load)[0] == "model" and len(loads) == 2
    s.drop()
    assert not s.loaded()
    monkeypatch.setenv("LEAFGRADE_MODEL_TTL", "7")
    assert models.time_limit() == 7
    monkeypatch.setenv("LEAFGRADE_MODEL_TTL", "x")
    assert models.time_limit() == models.TTL_SECONDS


def lines_image(degrees, size=400):
    y, x = np.mgrid[0:size, 0:size]
    return np.where(((y - x * math.tan(math.radians(degrees))) % 40) < 6, 0, 255).astype(np.uint8)


@pytest.mark.parametrize("degrees", [-10, -3, 0, 5, 20])
def test_skew(degrees):
    g = lines_image(degrees)
    assert images.measure(400, 400, g.tobytes())[2] == pytest.approx(degrees, abs=0.6)


def test_image_measures(spark):
    flat = np.full((50, 60), 9, np.uint8)
    assert images.measure(60, 50, flat.tobytes()) == (0.0, 0.0, None)
    rng = np.random.default_rng(1)
    sharp = rng.integers(0, 256, (50, 60), dtype=np.uint8)
    soft = np.stack([np.convolve(r, np.ones(7) / 7, "same") for r in sharp]).astype(np.uint8)
    contrast, blur, _ = images.measure(60, 50, sharp.tobytes())
    assert contrast == round(float(sharp.std()) / 255, 4) and blur > 5 * images.measure(60, 50, soft.tobytes())[1]
    head = b"P5\n# made here\n60 50\n255\n"
    rows = spark.createDataFrame([(1, bytearray(head + sharp.tobytes())), (2, bytearray(head + b"short")), (3, bytearray(b"P6 1 1 255 x")), (4, None), (5, bytearray(b"P5 60"))], "id int, content binary")
    got = {r.id: r for r in images.image_quality(rows, images.pgm).collect()}
    assert got[1].contrast == contrast and got[1].image_error is None and all(got[i].image_error and got[i].contrast is None for i in (2, 3, 4, 5))


def test_page_documents(spark, tmp_path):
    rows = [(k // 2, k, f"p{k}") for k in (3, 1, 0, 2, 4)]
    df = spark.createDataFrame(rows, "sub_batch long, batch_index long, text string")
    assert {r.name for r in sinks.write_page_documents(df, f"file://{tmp_path}/docs").collect()} == set(os.listdir(tmp_path / "docs"))
    assert (tmp_path / "docs" / "batch-00000001.txt").read_text() == "p2\fp3"

    def fails(pages):
        raise ValueError("no writer")

    with pytest.raises(Exception, match="no writer"):
        sinks.write_page_documents(df, f"file://{tmp_path}/bad", fails).collect()


def test_rendered_pages(spark, tmp_path):
    files = spark.createDataFrame([("d/a.pdf", bytearray(b"x\fy\fz")), ("e/a.pdf", bytearray(b"x"))], "path string, content binary")
    wanted = spark.createDataFrame([("d/a.pdf", 2), ("d/a.pdf", 0), ("d/a.pdf", 7), ("e/a.pdf", -1), ("e/a.pdf", 0)], "path string, page_number int")

    def draw(content, n):
        if content == b"x":
            raise ValueError("blank")
        return content.split(b"\f")[n]

    drawn, left = sinks.rendered_pages(files, wanted, draw, lambda c: c.count(b"\f") + 1)
    assert sorted((r.path, r.page_number, bytes(r.image)) for r in drawn.collect()) == [("d/a.pdf", 0, b"x"), ("d/a.pdf", 2, b"z")]
    assert sorted((r.page_number, r.problem) for r in left.collect()) == [(-1, "page -1 is out of range 0-0"), (0, "ValueError: blank"), (7, "page 7 is out of range 0-2")]
    assert {r.name for r in sinks.write_images(drawn, f"file://{tmp_path}/img").collect()} == {"a-page_000.png", "a-page_002.png"}


def test_pages_to_draw(spark):
    docs = spark.createDataFrame([("a", ([3, 1], [1, 9])), ("b", (None, None))], "id string, selected_pages struct<difficult:array<int>,regression:array<int>>")
    assert [r.page_number for r in sources.wanted_pages(docs, "a").collect()] == [1, 3, 9]
    assert [r.page_number for r in sources.wanted_pages(docs, "b", [4, 2, 4]).collect()] == [2, 4] and sources.wanted_pages(docs, "b").count() == 0
    with pytest.raises(LookupError):
        sources.wanted_pages(docs, "c")


def test_places(spark):
    rng = np.random.default_rng(3)
    rows = [("hot" if i % 3 else None if i % 2 else f"g{i % 7}", int(v)) for i, v in enumerate(rng.permutation(500))]
    got = placed(spark.createDataFrame(rows, "g string, v int"), ["g"], ["v"]).collect()
    for g in {r.g for r in got}:
        own = sorted((r.v, r.place) for r in got if r.g == g)
        assert [p for _, p in own] == list(range(len(own)))
    assert placed(spark.createDataFrame([], "g string, v int"), ["g"], ["v"]).count() == 0


def test_small_limits_still_give_two_pages_of_a_category(spark):
    rows = [(f"f{i}", 0, ["gray_zone"]) for i in range(9)] + [(f"f{i}", 1, ["layout_error", "bad_scan"]) for i in range(3)]
    pages = spark.createDataFrame(rows, "filename string, page_number long, struggle array<string>")
    chosen = {(r.filename, r.page_number) for r in coverage.difficult_pages(pages, 1, 1, 1).collect()}
    assert sum(p == 0 for _, p in chosen) >= 2 and sum(p == 1 for _, p in chosen) >= 2


def test_dictionary_without_broadcasting_all_words(spark, monkeypatch):
    from leafgrade.operators import signals

    rng = np.random.default_rng(5)
    some = ["the", "house", "xkjhg", "Bewusstsein", "strngth", "aaaa", "tree"]
    rows = [(i, " ".join(rng.choice(some, 30))) for i in range(40)] + [(40, ""), (41, None)]
    pages = spark.createDataFrame(rows, "id int, text string")
    vocab = spark.createDataFrame([("the",), ("house",)], "word string")
    want = sorted(signals.dictionary(pages, vocab, ["id"]).collect())
    monkeypatch.setattr(signals, "BROADCAST_WORDS", 0)
    monkeypatch.setattr(signals, "HOT_SHARE", 7)
    assert sorted(signals.dictionary(pages, vocab, ["id"]).collect()) == want and len(want) == 42


def test_service(spark, folder):
    warmed = []
    with service.Service(spark, words(spark, folder), make_engine=repairing_engine, warm=lambda: warmed.append(1)) as s:
        assert warmed == [1]
        one = RunConfig(f"file://{folder}/in/a", f"file://{folder}/one", extract_text=True)
        got = s.ocr(one, output_name="new.txt", page_range="2-2")
        assert got["n_files"] == 1 and got["files"][0]["page_count"] == 1 and got["files"][0]["output_path"].endswith("/new.txt")
        assert "error" in s.ocr(one, page_range="3-9") and "error" in s.ocr(RunConfig(" ", "x"))
        assert "error" in s.ocr(config(folder, "two"), output_name="n")
        job = s.start(config(folder, "job"))["job_id"]
        bad = s.start(RunConfig(f"file://{folder}/missing", "x"))["job_id"]
        for _ in range(600):
            if s.status(job)["status"] != "running" and s.status(bad)["status"] != "running":
                break
            time.sleep(0.1)
        done = s.status(job)
        assert done["status"] == "completed" and done["result"]["success_count"] == 2 and done["told"]["stage"] == "run"
        assert s.status(bad)["status"] == "failed" and s.status(bad)["error"] and "error" in s.status("nobody")
        assert service.expired_jobs(s.table(), time.time() + 4000).count() == 2 and service.expired_jobs(s.table(), time.time()).count() == 0
        assert s.memory()["model_seconds"] > 0
        assert set(s.forget_expired(time.time() + 4000)) == {job, bad} and not s.jobs


def test_named_output_is_for_one_file(spark):
    with pytest.raises(ValueError):
        sinks.named_output(spark.createDataFrame([("a",), ("b",)], "output_path string"), "n")
    assert issubclass(EnvironmentProblems, LeafgradeError)
