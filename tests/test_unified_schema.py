"""The unified layout: a document is parsed once, and only containers are no text."""

from metasift.operators import extract as ex


def test_a_document_is_parsed_once(spark):
    docs = spark.createDataFrame([(1, "{}")], "config_id long, result string")
    plan = ex.unified_schema(docs)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("parse_json") + plan.count("parsejson") == 1


def test_texts_like_containers_are_texts(spark):
    rows = [(1, '{"source_config":{"type":"{x}","service_name":"[y","host":{"a":1},"port":5,"table":"","path":null,"uri":[1]},"ingestion_config":{"steps":["a"],"frequency":"d"},"platform":true}'),
            (1, "{"), (None, None), (2, '{"source_config":{"type":{"a":1},"source_type":"s","connection":{"host":"h","port":{"b":2}},"port":1.50}}')]
    got = {(r.config_id, r.source_type, r.service_name, r.frequency, tuple(sorted(r.connection_details.items())), r.flow_text)
           for r in ex.unified_schema(spark.createDataFrame(rows, "config_id long, result string")).collect()}
    none = ("Unknown", "Unknown", None, (), "Unknown: source_1 -> sink_1")
    assert got == {(1, "{x}", "[y", "d", (("port", "5"),), "true: source_1 -> step_1 -> sink_1"), (1, *none), (None, *none), (2, "s", "Unknown", None, (("host", "h"), ("port", "1.5")), "Unknown: source_1 -> sink_1")}
