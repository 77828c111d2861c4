import json
import uuid

from pyspark.sql import functions as F

from mnemoframe.operators import mutations
from mnemoframe.plans import tools
from mnemoframe.sources import io
from mnemoframe.sources.catalog import MemoryCatalog
from mnemoframe.streaming import queries as st, sinks


def test_remember_recall_and_edit_through_the_catalog(spark, tmp_path):
    catalog = MemoryCatalog(spark, f"mf_{uuid.uuid4().hex}")
    catalog.create(str(tmp_path / "db"))
    now = F.expr("TIMESTAMP '2024-02-01 00:00:00'")
    inputs = spark.createDataFrame(
        [("t", "user", "me", "s1", "conversation", "user: I live in Oslo.\nuser: I like tea."),
         ("t", "user", "me", "s1", "conversation", "I work at Acme Labs. It was with Jane Doe.")],
        "tenant_id string, scope string, scope_id string, session_id string, input_type string, "
        "data string")
    tools.remember(catalog, inputs, now)
    tools.remember(catalog, inputs, now)  # the same inputs again change nothing
    assert tools.stats(catalog)["facts"] == 3
    assert catalog.table("extractions").count() == 2
    names = {r.canonical_name for r in catalog.table("entities").collect()}
    assert {"user", "jane doe", "acme labs"} <= names
    facts = catalog.table("facts")
    asked = facts.where("content = 'User lives in Oslo'").select(
        F.lit(1).alias("query_id"), "tenant_id", "scope", "scope_id",
        F.lit("where does the user live, Oslo?").alias("query"), "embedding")
    asked = spark.createDataFrame(asked.collect(), asked.schema)
    top = tools.recall(catalog, asked, now).orderBy("rank").first()
    assert top.content == "User lives in Oslo"
    home = facts.where("content = 'User lives in Oslo'").select("fact_id")
    catalog.change("facts", home.join(facts, "fact_id"), lambda rows: tools.set_metadata(rows, tools.dismissals(home, now)))
    left = [r.content for r in tools.recall(catalog, asked, now).collect()]
    assert "User lives in Oslo" not in left


def test_transcripts_and_source_files(spark, tmp_path):
    rows = [{"type": "human", "sessionId": "s", "message": {"role": "user", "content": "hi"}},
            {"type": "system", "sessionId": "s"},
            {"type": "assistant", "sessionId": "s", "message": {"role": "assistant", "content": "yo"}}]
    (tmp_path / "log.jsonl").write_text("\n".join(json.dumps(r) for r in rows))
    got = io.read_transcript(spark, str(tmp_path / "log.jsonl")).collect()
    assert [(r.role, r.content) for r in got] == [("user", "hi"), ("assistant", "yo")]
    code = tmp_path / "code" / "a" / "b"
    code.mkdir(parents=True)
    (tmp_path / "code" / "node_modules").mkdir()
    (tmp_path / "code" / "node_modules" / "index.js").write_text("x")
    (tmp_path / "code" / "README.md").write_text("x")
    for name, size in (("big.py", 500), ("small.py", 50), ("main.py", 900), ("index.ts", 400), (".hidden.py", 1)):
        (code / name).write_text("x" * size)
    files = io.key_source_files(spark, str(tmp_path / "code"), depth=4, top=15).collect()
    assert [r.path.rsplit("/", 1)[1] for r in files] == ["index.ts", "main.py", "small.py", "big.py"]


def test_partitioned_facts_prune_scans(spark, tmp_path):
    df = spark.range(100).select(F.concat(F.lit("t"), F.col("id") % 4).alias("tenant_id"),
                                 F.lit("user").alias("scope"), F.col("id").alias("fact_id"))
    io.write_facts(df, str(tmp_path / "facts"))
    back = spark.read.parquet(str(tmp_path / "facts")).where("tenant_id = 't1'")
    assert "PartitionFilters: [isnotnull(tenant_id" in back._jdf.queryExecution().toString()
    assert back.count() == 25


def test_stream_replay_overwrites_its_own_batches(spark, tmp_path):
    schema = "tenant_id string, ts timestamp, queries long"
    source = tmp_path / "in"
    for day in (1, 2):
        spark.createDataFrame([("t", 5 * day)], "tenant_id string, queries long").select(
            "tenant_id", F.lit(f"2024-01-0{day} 00:00:00").cast("timestamp").alias("ts"),
            "queries").write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        sinks.run_available(st.monthly_usage(stream, ["queries"]), str(tmp_path / "out"),
                            str(tmp_path / "ckpt"), "update")
    out = spark.read.parquet(str(tmp_path / "out"))
    row = sinks.latest(out, "tenant_id", "period_start").collect()
    assert [r.queries for r in row] == [15]


def test_decay_counts_the_accesses_of_all_batches(spark, tmp_path):
    facts = spark.createDataFrame([(1, 0.8, 1)], "fact_id long, importance double, frequency long")
    for batch in range(3):
        spark.createDataFrame([(1,)] * 3, "fact_id long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("fact_id long").parquet(str(tmp_path / "in"))
        sinks.run_available(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"), "append", mutations.access_hits)
    log = spark.read.parquet(str(tmp_path / "out"))
    assert log.count() == 3
    got = mutations.decay_after(facts, log, F.expr("TIMESTAMP '2024-01-01 00:00:00'")).collect()
    assert [r.new_frequency for r in got] == [10]


def test_repeated_inputs_choose_the_same_row(spark):
    rows = [("t", "h", "s2", 5), ("t", "h", "s1", 9), ("t", "h", "s1", 7)]
    seen = spark.createDataFrame([], "tenant_id string, hash string")
    for order in (rows, rows[::-1]):
        incoming = spark.createDataFrame(order, "tenant_id string, hash string, session_id string, turn int").repartition(3)
        got = mutations.only_new(seen, incoming, "tenant_id", "hash").collect()
        assert [(r.session_id, r.turn) for r in got] == [("s1", 7)]


def test_a_change_writes_the_partitions_it_touches(spark, tmp_path):
    catalog = MemoryCatalog(spark, "edits", str(tmp_path / "store"))
    catalog.create()
    assert catalog.table("facts").count() == 0
    rows = spark.range(400).select(
        F.col("id").cast("string").alias("fact_id"), F.when(F.col("id") % 4 < 3, F.concat(F.lit("t"), F.col("id") % 4)).alias("tenant_id"),
        F.when(F.col("id") % 8 < 4, "user").otherwise("agent").alias("scope"), F.lit("old").alias("content"), F.lit(1).alias("version"))
    catalog.append("facts", rows.where("id < 300"))
    catalog.append("facts", rows.where("id >= 300"))
    catalog.create()  # again changes nothing
    before = {str(p): p.stat().st_mtime_ns for p in (tmp_path / "store" / "facts" / "rows").rglob("*.parquet")}
    reader = catalog.table("facts")
    assert reader.count() == 400
    now = F.expr("TIMESTAMP '2024-02-01 00:00:00'")
    edits = spark.createDataFrame([("5", "n5", "new"), ("13", "n13", None)], "fact_id string, new_fact_id string, new_content string")
    tools.edit(catalog, edits, now)
    after = {str(p): p.stat().st_mtime_ns for p in (tmp_path / "store" / "facts" / "rows").rglob("*.parquet")}
    new = set(after) - set(before)
    assert new and all("tenant_id=t1/scope=agent" in p for p in new) and all(after[p] == before[p] for p in before)
    assert reader.count() == 400  # a plan made before reads what was there
    facts = catalog.table("facts")
    assert facts.count() == 402
    told = {r.fact_id: (r.version, r.content, r.valid_until is None) for r in facts.where("fact_id in ('5', 'n5', 'n13', '6')").collect()}
    assert told == {"5": (1, "old", False), "n5": (2, "new", True), "n13": (2, "old", True), "6": (1, "old", True)}
    # a writer that fails before its commit leaves nothing to read
    catalog._table("facts").read().limit(3).withColumn("_commit", F.lit("lost")).write.mode("append").partitionBy(
        "tenant_id", "scope", "_commit").parquet(str(tmp_path / "store" / "facts" / "rows"))
    assert catalog.table("facts").count() == 402
    catalog.change("facts", facts.where("tenant_id is null").select("tenant_id", "scope"), lambda rows: rows.limit(0))
    assert catalog.table("facts").where("tenant_id is null").count() == 0 and catalog.table("facts").count() == 302
    catalog.replace("facts", catalog.table("facts").where("scope = 'user'"))
    assert {r.scope for r in catalog.table("facts").select("scope").distinct().collect()} == {"user"}
    links = spark.createDataFrame([("1", "e", "mentioned")], "fact_id string, entity_id string, role string")
    catalog.append("fact_entities", links)
    catalog.replace("fact_entities", links.withColumn("role", F.lit("subject")))
    assert [r.role for r in catalog.table("fact_entities").collect()] == ["subject"]


def test_filters_reach_the_folders_of_a_partitioned_table(spark, tmp_path):
    catalog = MemoryCatalog(spark, "plans", str(tmp_path / "store"))
    catalog.create()
    catalog.append("facts", spark.range(8).select(F.concat(F.lit("t"), "id").alias("tenant_id"), F.lit("user").alias("scope"), F.col("id").cast("string").alias("fact_id")))
    plan = catalog.table("facts").where("tenant_id = 't3' and scope = 'user'").select("fact_id")._jdf.queryExecution().executedPlan().toString()
    filters = [part.split("]")[0] for part in plan.split("PartitionFilters: [")[1:]]
    assert any("tenant_id" in f and "t3" in f and "scope" in f for f in filters)
    assert "content" not in plan


def test_outbox_spreads_the_events_of_one_file(spark, tmp_path):
    events = spark.range(64).select(F.lit("t").alias("tenant_id"), F.lit("made").alias("event"), F.col("id").cast("string").alias("payload"))
    hooks = spark.createDataFrame([("t", "w1", "k", True, ["made"]), ("t", "w2", "k", True, ["gone"]), ("t", "w3", "l", False, ["made"])],
                                  "tenant_id string, webhook_id string, secret string, active boolean, events array<string>")
    got = st.outbox(events.coalesce(1), hooks)
    assert got.columns == ["tenant_id", "event", "payload", "webhook_id", "signature"]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # else the few events travel
    rows = got.withColumn("task", F.spark_partition_id()).collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len({r.payload for r in rows}) == len(rows) == 64 and {r.webhook_id for r in rows} == {"w1"}
    assert len({r.task for r in rows}) > 1
