import json

from pyspark.sql import functions as F

from weft.operators import catalog as C
from weft.operators import conversation as V
from weft.operators import vectorstore
from weft.sources import catalogs, shards


def test_csv_folder(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Task/Intent,command,extra\nOpen App,open chrome,1\nOpen App,,2\nClose/Quit,close it,3\n")
    (tmp_path / "b.csv").write_text("Task/Intent,command,extra\nOpen App,open chrome,9\n")
    (tmp_path / "c.txt").write_text("not a table")
    rows = catalogs.commands(spark, str(tmp_path))
    assert sorted((r["task_intent"], r["command_text"], r["function_name"]) for r in rows.collect()) == [("Close/Quit", "close it", "close_quit"), ("Open App", "open chrome", "open_app"), ("Open App", "open chrome", "open_app")]
    old = spark.createDataFrame([("close it",)], "command_text string")
    new = C.insert_absent(old, rows, "command_text", "line").collect()
    assert [r["command_text"] for r in new] == ["open chrome"]


def test_settings_round_trip(spark, tmp_path):
    rows = [("voice", "volume", "80"), ("voice", "type", "male"), ("assistant", "name", "Nova")]
    settings = spark.createDataFrame(rows, "category string, key string, value string")
    catalogs.export_settings(settings, str(tmp_path / "s"))
    (part,) = (tmp_path / "s").glob("part-*")
    assert json.loads(part.read_text()) == {"voice": {"volume": "80", "type": "male"}, "assistant": {"name": "Nova"}}
    assert sorted(map(tuple, catalogs.import_settings(spark, str(tmp_path / "s")).collect())) == sorted(rows)
    got = C.assistant(settings.union(spark.createDataFrame([("assistant", "owner_name", "An")], "a string, b string, c string"))).first()
    assert (got["volume"], got["voice_type"], got["greeting"]) == ("80", "male", "Welcome back An")


def test_dictionary(spark, tmp_path):
    (tmp_path / "d.txt").write_text("Việt_Nam 20\nhà_nội\n\nx abc\n")
    assert {r["word"]: r["count"] for r in catalogs.dictionary(spark, str(tmp_path / "d.txt")).collect()} == {"việt_nam": 20, "hà_nội": 10, "x": 10}


def test_intents_keep_their_order(spark):
    texts = ["restart the system", "file browser", "browsing file", "taskbar", "internet connectivity", "none of them", "Screen capture", "system settings"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", C.intent(F.col("t")).alias("i")).collect()
    assert {r["t"]: r["i"] for r in rows} == dict(zip(texts, ["open_application", "file_management", "web_browsing", "task_management", "network_management", None, "screen_capture", "open_system_settings"]))


def test_counters_and_changes(spark):
    old = spark.createDataFrame([("search", "a", 2, "2024-01-01")], "command_type string, pattern string, count long, last_used string")
    used = spark.createDataFrame([("search", "a", "2024-02-01"), ("play", "b", "2024-02-02")], "command_type string, pattern string, last_used string")
    assert sorted(map(tuple, C.upsert_count(old, used, ["command_type", "pattern"]).collect())) == [("play", "b", 1, "2024-02-02"), ("search", "a", 3, "2024-02-01")]
    assert C.create(spark, "learned_commands").count() == 9 and C.create(spark, "web_command").count() == 2 and C.create(spark, "settings").count() == 0


def test_cascade(spark):
    names = spark.createDataFrame([("open chrome browser", "f1"), ("open chrome", "f2"), ("Play music", "f3")], "command_text string, function_name string")
    asked = spark.createDataFrame([(1, "PLAY MUSIC"), (2, "chrome"), (3, "some music or so"), (4, "x")], "id long, q string")
    got = {r["id"]: (r["how"], r["function_name"]) for r in C.cascade(asked, names, "id", "q", "command_text", 3, ["function_name"]).collect()}
    assert got == {1: ("exact", "f3"), 2: ("partial", "f2"), 3: ("word", "f3")}


def test_budget_keeps_a_suffix(spark):
    turns = spark.createDataFrame([(1, t, "user", "x" * 400) for t in range(60)], "conv_id long, turn long, role string, text string")
    kept = sorted(r["turn"] for r in V.within_budget(turns, V.rough_tokens(F.col("text")), 50, 46, 1096).collect())
    assert kept == list(range(50, 60))
    messages = V.prompts(turns.where("turn < 2"), "sys").first()["messages"]
    assert [m["role"] for m in messages] == ["system", "user", "user"]
    store = turns.select("text").limit(0)
    assert V.save_memory(store, spark.createDataFrame([("mail a@b.co or 0912345678",)], "text string")).first()["text"] == "mail [REDACTED_EMAIL] or [REDACTED_PHONE]"


def test_vector_store(spark, tmp_path):
    store = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.0, 2.0], "b"), (3, [1.0, 1.0], "c")], "vec_id long, embedding array<double>, meta string")
    vectorstore.save(vectorstore.add(store.where("vec_id < 3"), store.where("vec_id = 3")), str(tmp_path / "v"))
    held = vectorstore.load(spark, str(tmp_path / "v"))
    q = spark.createDataFrame([(7, [3.0, 0.1])], "query_id long, query array<double>")
    assert [r["vec_id"] for r in vectorstore.search(held, q, 5).orderBy("rank").collect()] == [1, 3, 2]
    assert vectorstore.clear(held).count() == 0


def test_shards(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"line {k}\nmore") for k in range(250)], "doc_id long, text string")
    got = {r["doc_id"]: r["shard"] for r in shards.numbered(docs, "doc_id", 100).collect()}
    assert got == {k: k // 100 for k in range(250)}
    shards.write_shards(docs, str(tmp_path / "out"), size=100)
    lines = shards.read_lines(spark, str(tmp_path / "out"))
    assert lines.count() == 250 and lines.where("text LIKE '%\n%'").count() == 0
    assert all(f.read_text().count("\n") <= 100 for f in (tmp_path / "out").glob("part-*"))
