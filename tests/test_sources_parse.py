import json
import os

import pytest
from shobdo.operators.parse import failures_by_file, parse_lines, rejected, typed
from shobdo.sources import corpora, sinks


def test_csv_corpora(spark, tmp_path):
    (tmp_path / "sentnob").mkdir()
    for name, n in (("train", 4), ("val", 1), ("test", 2)):
        (tmp_path / "sentnob" / f"{name}.csv").write_text("Data,Label\n" + "".join(f'"লেখা ""{i}"", দুই\nলাইন", {i % 3} \n' for i in range(n)) + ",0\n", encoding="utf-8")
    df, warnings = corpora.load_raw(spark, str(tmp_path), "sentnob")
    rows = df.collect()
    assert len(rows) == 10 and not warnings and rows[0].text == 'লেখা "0", দুই\nলাইন' and sum(r.text == "" for r in rows) == 3
    (tmp_path / "LabeledAuthentic-7K.csv").write_text("articleID,content\n1,x\n2,y\n", encoding="utf-8")
    fake, warnings = corpora.load_raw(spark, str(tmp_path), "banfakenews", limit=1)
    assert [r.label for r in fake.collect()] == [1] and len(warnings) == 1
    (tmp_path / "bd.csv").write_bytes("a,b\n1,ok\n2,".encode() + b"\xff\n")
    inv = corpora.file_inventory(spark, str(tmp_path / "bd.csv")).first()
    assert inv.utf8_decode_failures == 1 and inv.columns == "a|b" and len(inv.sha256) == 64 and (inv.n_rows, inv.n_rows_inspected) == (2, 2)
    (tmp_path / "quoted.csv").write_text('"a,b",c\n"x\ny",1\n\nz,2\n', encoding="utf-8")
    inv = corpora.file_inventory(spark, str(tmp_path / "quoted.csv"), limit=1).first()
    assert (inv.n_columns, inv.columns, inv.n_rows, inv.n_rows_inspected, inv.dtypes) == (2, "a,b|c", 2, 1, "string|string")
    with pytest.raises(ValueError):
        corpora.pick(["x"], ("text",))
    bad = spark.createDataFrame([("a", "7")], "Data string, Label string")
    with pytest.raises(ValueError, match="7"):
        corpora.resolve_labels(bad, "sentnob")
    scan = {os.path.basename(r.path): r.n_bengali for r in corpora.hygiene(spark, str(tmp_path)).collect()}
    assert scan["train.csv"] > 0 and scan["bd.csv"] == 0


def test_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "results")
    df = spark.createDataFrame([("r", "on", None, 0, 0.5), ("r", "on", None, 0, 0.6), ("r", "on", "x", 1, 0.4)], "run_id string, normalizer string, noise_type string, severity int, f1 double")
    for _ in range(3):
        sinks.append_results(df, path)
    assert spark.read.parquet(path).count() == 2


def test_stream_appends_once(spark, tmp_path):
    from shobdo.streaming.noise_stream import append_stream, first_by_key, noised_stream

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(i, "বাংলা লেখা পড়ি") for i in range(6)] * 2, "id long, text string").write.parquet(src)
    for k in range(2):
        stream = noised_stream(spark.readStream.schema("id long, text string").parquet(src), "char_delete", 3, 42)
        q = append_stream(stream.select("id", "severity", "noised"), out, str(tmp_path / f"ck{k}"), ["id", "severity"])
        q.awaitTermination(60)
    assert spark.read.parquet(out).count() == 6
    assert first_by_key(spark.readStream.schema("id long, ts timestamp").parquet(src), ["id"], "ts").isStreaming


def test_stages_and_resume(spark, tmp_path):
    done = []
    stages = {"a": lambda: done.append("a") or 0, "b": lambda: done.append("b") or 3, "c": lambda: done.append("c") or 0}
    assert sinks.run_stages("all", stages) == 3 and done == ["a", "b"]
    with pytest.raises(ValueError):
        sinks.run_stages("z", stages)
    marker, meta = tmp_path / "m", tmp_path / "meta"
    run = lambda limit=None, force=False: sinks.should_run(str(marker), str(meta), limit, force)
    assert run()
    marker.write_text("")
    assert run() and run(5) and run(force=True)  # a marker without metadata
    meta.write_text(json.dumps({"limited": True}))
    assert run()
    meta.write_text(json.dumps({"limited": False}))
    assert not run()
    assert ".smoke" in sinks.smoke_path("out/x", 5) and sinks.smoke_path("out/x", None) == "out/x"
    table = sinks.latex_table(spark.createDataFrame([("t", "m", 0.5), ("t", "n", 0.7)], "a string, b string, v double"), "a", "b", "v")
    assert r"\textbf{0.700}" in table
    curves = spark.createDataFrame([("r", 1, "t", "m", 0.1, 1), ("r", 1, "t", "m", 0.9, 2)], "run_id string, epoch int, task string, model string, val_macro_f1 double, seq int")
    assert sinks.training_curves(curves).first().mean == 0.9


def test_parse_reasons(spark):
    cases = [
        (b"x,1", None), (b'"a ""q"", b",2\r', None), (b'"two\nlines", 0 ', None), (b",0", None), (b"x,3", "value"), (b"x,", "value"), (b"x", "columns"),
        (b"x,1,2", "columns"), (b"", "columns"), (None, "columns"), (b'"open,1', "quoting"), (b'"a"b,1', "quoting"), (b'a"b,1', "quoting"), (b"\xff,1", "encoding"),
        (b"\xff\"a\"b", "encoding"), (b"cr\rin,1", None), (b"\xef\xbb\xbfbom,1", None), ("x,১".encode(), "value"), (b"x" * 100_000 + b",1", None),
    ]
    lines = spark.createDataFrame([(i, "f.csv", i, raw, "extra") for i, (raw, _) in enumerate(cases)] + [(900, "unknown.csv", 1, b"x,1", "")] * 2 + [(901, "n.csv", 1, b"12,2020-02-30,t,1", ""), (902, "n.csv", 2, b"12,2020-02-29,t,1.0", ""), (903, "n.csv", 3, b",2020-02-29,t,1.0", "")],
                                  "line_id long, file_name string, line_no int, raw binary, columns string")
    files = spark.createDataFrame([("f.csv", "Data|Label"), ("f.csv", "Data|Label"), ("n.csv", "articleID|date|content|label")], "file_name string, columns string")
    parsed = parse_lines(lines, files)
    got = {r.line_id: r.reason for r in parsed.collect()}
    assert {i: got[i] for i in range(len(cases))} == {i: why for i, (_, why) in enumerate(cases)}
    assert got[900] == "columns" and got[901] == "value" and got[902] is None and got[903] == "value"
    ok = {r.line_id: r for r in typed(parsed).collect()}
    assert ok[1].text == 'a "q", b' and ok[1].label == 2 and ok[2].text == "two\nlines" and ok[15].text == "cr\rin" and ok[16].text == "﻿bom"
    assert ok[902].label == 1 and str(ok[902].published) == "2020-02-29" and ok[902].fields["content"] == "t"
    bad = {r.line_id: r.bad_cells for r in rejected(parsed).collect()}
    assert bad[901] == ["date"] and bad[903] == ["articleID"]
    assert failures_by_file(parsed).where("file_name = 'n.csv' and reason = 'value'").first().n_rows == 2
    assert parse_lines(lines.limit(0), files).count() == 0 and rejected(parse_lines(lines, files.limit(0))).where("reason = 'columns'").count() > 5


def test_files_by_later_patterns(tmp_path):
    (tmp_path / "sentnob" / "deep").mkdir(parents=True)
    (tmp_path / "sentnob" / "dev.csv").write_text("")
    (tmp_path / "sentnob" / "deep" / "my_train_1.csv").write_text("")
    at = {split: corpora.locate(str(tmp_path), name, patterns) for name, patterns, split, _ in corpora.FILES if name == "sentnob"}
    assert at["val"].endswith("dev.csv") and at["train"].endswith("my_train_1.csv") and at["test"] is None


def test_all_stand_ins_taken(spark):
    every = "".join(chr(c) for c in range(0xFDD0, 0xFDF0)).encode()
    rows = [(0, "f.csv", 1, every + b",1"), (1, "f.csv", 2, b'"a\nb\rc' + every[:3] + b'",2')]
    df = spark.createDataFrame(rows, "line_id long, file_name string, line_no int, raw binary").coalesce(1)
    out = {r.line_id: r.text for r in typed(parse_lines(df, spark.createDataFrame([("f.csv", "Data|Label")], "file_name string, columns string"))).collect()}
    assert out == {0: every.decode(), 1: "a\nb\rc" + every[:3].decode()}


def test_days():
    import datetime

    import pyarrow as pa
    from shobdo.operators.parse import days

    cases = ["2020-02-29", "2021-02-29", "1900-02-29", "2000-02-29", "0000-01-01", "0001-01-01", "9999-12-31", "2020-13-01", "2020-00-10", "2020-01-32", "2020-04-31", "2020-1-01", "", "2020-01-01\n", "২০২০-০১-০১", "2020/01/01"]
    real, day = days(pa.array(cases))

    def want(s):
        try:
            return datetime.date.fromisoformat(s) if len(s) == 10 and s.isascii() else None
        except ValueError:
            return None

    assert [d if k else None for d, k in zip(day.tolist(), real.tolist())] == [want(s) for s in cases]


def test_tables_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([("d", "train", "a", "x", 0), ("d", "test", "b", "y", 1), ("d", "train", "c", "z", 1)], "dataset string, final_split string, id string, text string, label int")
    sinks.write_splits(df, str(tmp_path / "final"))
    assert [r.id for r in corpora.load_final(spark, str(tmp_path / "final"), "d", "train", 1).collect()] == ["a"] and corpora.load_final(spark, str(tmp_path / "final"), "d", "train").count() == 2
    m = sinks.write_manifest(df, str(tmp_path / "m.json"), 42, {"a.csv": "00"})
    assert json.loads((tmp_path / "m.json").read_text())["splits"] == m["splits"] and m["seed"] == 42 and [s["n"] for s in m["splits"]] == [1, 2]
    t = spark.createDataFrame([("t", "m", 0.5, 0.1, 3), ("t", "n", 0.75, None, 3)], "task string, model string, mean double, std double, count int")
    sinks.write_table(t, str(tmp_path / "t"), {"mean": 3, "std": 2}, ["model"])
    text = next((tmp_path / "t").glob("*.csv")).read_text().splitlines()
    assert text[0] == "task,model,mean,std,count" and text[1] == "t,m,0.500,0.10,3" and text[2].startswith("t,n,0.750,")
    assert r"\textbf{0.750}" in sinks.clean_latex(t) and r"\textbf{0.500}" not in sinks.clean_latex(t)
    assert sinks.markdown(t).splitlines()[2] == "| t | m | 0.500 | 0.100 | 3 |"
