"""Model maintenance on two small documents."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.plans import mining, model
from tidemark.session import materialize

DOC = {
    "version": 1,
    "data_sources": {"tables": [
        {"identifier": "main.s.orders", "column_configs": [{"column_name": "total", "synonyms": ["sum", "amount"], "get_example_values": True}]},
        {"identifier": "main.s.order_items", "column_configs": []},
    ]},
    "instructions": {
        "text_instructions": [{"id": "0" * 32, "content": ["old"]}],
        "example_question_sqls": [{"id": "1" * 32, "question": ["top orders"], "sql": ["SELECT 1"]}],
        "sql_snippets": {"filters": [{"id": "f1", "sql": ["a"], "display_name": "big"}], "expressions": [], "measures": []},
        "join_specs": [{"id": "2" * 32, "left": {"identifier": "main.s.orders", "alias": "o"}, "right": {"identifier": "main.s.order_items", "alias": "i"}, "sql": ["x = y "]}],
    },
}


@pytest.fixture(scope="module")
def models(spark):
    df = spark.createDataFrame([(1, json.dumps(DOC)), (2, json.dumps({"version": 1}))], "model_id bigint, d string")
    return materialize(model.read_documents(df, "d"), "models")


def make_fixes(spark, rows):
    schema = spark.createDataFrame([], model.FIX_COLUMNS).schema
    full = [{f.name: None for f in schema.fields} | {"model_id": 1, "fix_id": i} | r for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[f.name] for f in schema.fields) for r in full], schema)


def outcomes(spark, models, rows):
    relations, report = model.apply_plan(models, make_fixes(spark, rows))
    return relations, {r.fix_id: (r.applied, r.reason) for r in report.collect()}


def test_a_reference_takes_the_first_table_that_fits(spark, models):
    refs = spark.createDataFrame(
        [(1, "main.s.order_items"), (1, "ORDER_ITEMS"), (1, "order"), (1, "items"), (1, "none"), (2, "orders"), (3, "x")],
        "model_id bigint, table_ref string",
    )
    got = {(r.model_id, r.table_ref): r.table_pos for r in model.resolve_tables(refs, models).collect()}
    assert got == {
        (1, "main.s.order_items"): 1, (1, "ORDER_ITEMS"): 1, (1, "order"): 0, (1, "items"): 1, (1, "none"): None,
        (2, "orders"): None, (3, "x"): None,
    }


def test_apply_plan_outcomes_and_relations(spark, models):
    rows = [
        {"fix_category": "metadata_add", "fix_type": "add_synonym", "table_ref": "orders", "column_name": "total", "synonym": "sales"},
        {"fix_category": "metadata_add", "fix_type": "add_synonym", "table_ref": "orders", "column_name": "total", "synonym": "sales"},
        {"fix_category": "metadata_add", "fix_type": "add_synonym", "table_ref": "orders", "column_name": "new", "synonym": "n"},
        {"fix_category": "metadata_add", "fix_type": "add_synonym", "table_ref": "nowhere", "column_name": "c", "synonym": "s"},
        {"fix_category": "metadata_delete", "fix_type": "delete_synonym", "table_ref": "orders", "column_name": "total", "synonym": "sum"},
        {"fix_category": "metadata_delete", "fix_type": "delete_synonym", "table_ref": "main.s.orders", "column_name": "total", "synonym": "sum"},
        {"fix_category": "metadata_add", "fix_type": "delete_synonym", "table_ref": "orders", "column_name": "total", "synonym": "amount"},
        {"fix_category": "join_specs_add", "fix_type": "add_join_spec", "left_table": "a.b.Tab", "right_table": "a.b.Tab", "sql": ["k = k "], "left_alias": "z"},
        {"fix_category": "join_specs_delete", "fix_type": "delete_join_spec", "left_table": "main.s.orders", "right_table": "main.s.order_items"},
        {"fix_category": "instruction_fix", "fix_type": "update_text_instruction", "content": ["new"]},
        {"model_id": 2, "fix_category": "instruction_fix", "fix_type": "update_text_instruction", "content": ["first"]},
        {"fix_category": "sql_snippets_delete", "fix_type": "delete_filter", "display_name": "big"},
        {"fix_category": "sql_snippets_add", "fix_type": "add_measure", "alias": "m"},
        {"fix_category": "sample_queries_delete", "fix_type": "delete_example_query", "pattern_name": "top"},
        {"fix_category": "no_such", "fix_type": "anything"},
    ]
    relations, got = outcomes(spark, models, rows)
    assert got == {
        0: (True, None), 2: (True, None), 3: (False, "table not found"), 4: (True, None), 5: (False, "nothing matched"),
        7: (True, None), 8: (True, None), 9: (True, None), 10: (True, None), 11: (True, None), 12: (False, "missing field"),
        13: (True, None),
    }
    synonyms = {(r.column_name, r.synonym) for r in relations["synonyms"].collect()}
    assert synonyms == {("total", "amount"), ("total", "sales"), ("new", "n")}
    join = relations["joins"].collect()
    assert [(j.left_alias, j.right_alias, j.sql) for j in join] == [("z1", "z2", ["k = k ", "--rt=FROM_RELATIONSHIP_TYPE_MANY_TO_ONE--"])]
    assert {(r.model_id, r.content[0]) for r in relations["instructions"].collect()} == {(1, "new"), (2, "first")}
    assert relations["snippets"].count() == 0 and relations["examples"].count() == 0


def test_outcomes_belong_to_their_model(spark):
    second = json.loads(json.dumps(DOC))
    second["data_sources"]["tables"][0]["column_configs"][0]["synonyms"] = ["other"]
    second["instructions"]["example_question_sqls"] = []
    second["instructions"]["sql_snippets"]["filters"] = []
    second["instructions"]["join_specs"] = []
    df = spark.createDataFrame([(1, json.dumps(DOC)), (2, json.dumps(second))], "model_id bigint, d string")
    both = materialize(model.read_documents(df, "d"), "models")
    rows = [
        {"fix_category": "metadata_delete", "fix_type": "delete_synonym", "table_ref": "orders", "column_name": "total", "synonym": "sum"},
        {"fix_category": "sample_queries_delete", "fix_type": "delete_example_query", "pattern_name": "top"},
        {"fix_category": "sql_snippets_delete", "fix_type": "delete_filter", "display_name": "big"},
        {"fix_category": "join_specs_delete", "fix_type": "delete_join_spec", "left_table": "main.s.orders", "right_table": "main.s.order_items"},
    ]
    # fix ids restart in each model
    every = [r | {"model_id": m, "fix_id": i} for m in (1, 2) for i, r in enumerate(rows)]
    _, report = model.apply_plan(both, make_fixes(spark, every))
    got = sorted((r.model_id, r.fix_id, r.applied) for r in report.collect())
    assert got == [(1, i, True) for i in range(4)] + [(2, i, False) for i in range(4)]


def test_an_empty_description_is_missing(spark, models):
    fix = {"fix_category": "metadata_add", "fix_type": "add_table_description", "table_ref": "orders", "description": [""]}
    _, got = outcomes(spark, models, [fix])
    assert got[0] == (False, model.MISSING)


def test_dry_run_changes_nothing(spark, models):
    fix = {"fix_category": "metadata_add", "fix_type": "add_synonym", "table_ref": "orders", "column_name": "total", "synonym": "sales"}
    relations, report = model.apply_plan(models, make_fixes(spark, [fix]), dry_run=True)
    assert report.first().applied and relations["synonyms"].count() == 2


def test_parameters_are_cleaned(spark):
    df = spark.sql("select array(named_struct('name','a','type_hint','long','description',array('d')), named_struct('name','','type_hint','DATE','description',null), named_struct('name','b','type_hint','??','description',null)) as p")
    got = df.select(model.clean_parameters("p").alias("p")).first().p
    assert [(x.name, x.type_hint, x.description) for x in got] == [("a", "INTEGER", ["d"]), ("b", None, [])]


def test_validation_messages(spark):
    bad = json.loads(json.dumps(DOC))
    bad["data_sources"]["tables"][0]["identifier"] = "two.parts"
    bad["instructions"]["text_instructions"].append({"id": "xyz", "content": []})
    df = spark.createDataFrame([(1, json.dumps(bad)), (2, "{}")], "model_id bigint, d string")
    got = {(r.model_id, r.severity, r.message) for r in model.validate_models(model.read_documents(df, "d")).collect()}
    assert got == {
        (1, "error", "Invalid table identifier: two.parts"),
        (1, "error", "Maximum 1 text instruction allowed"),
        (1, "error", "Invalid UUID in instructions.text_instructions: xyz"),
        (1, "warning", f"Join {'2' * 32} missing relationship type marker"),
        (2, "error", "Missing required field: version"),
    }


def test_old_field_replaces_new(spark, models):
    moved = model.migrate_v1_v2(models).filter("model_id = 1").first()
    column = moved.data_sources.tables[0].column_configs[0]
    assert column.enable_format_assistance is True and column.get_example_values is None


def test_items_of_a_large_model(spark):
    many = {"synonyms": spark.range(500).select(
        F.lit(1).cast("bigint").alias("model_id"), F.lit(0).alias("table_pos"), F.lit("c").alias("column_name"),
        F.col("id").cast("string").alias("synonym"), F.col("id").cast("int").alias("pos"), F.lit(None).cast("bigint").alias("added_by"),
    )}
    rows = model.section_items(many).collect()
    assert sorted(json.loads(r["item"])["synonym"] for r in rows) == sorted(map(str, range(500)))


def shown(documents):
    return {r.model_id: json.loads(r.d) for r in documents.select("model_id", F.to_json(F.struct(*[c for c in documents.columns if c != "model_id"])).alias("d")).collect()}


def test_documents_there_and_back(spark, models):
    again = model.to_documents(model.explode_model(models), models)
    assert again.schema.simpleString() == models.schema.simpleString()
    first = shown(again)[1]
    assert first["data_sources"]["tables"] == [
        {"identifier": "main.s.orders", "column_configs": [{"column_name": "total", "synonyms": ["sum", "amount"], "get_example_values": True}]},
        {"identifier": "main.s.order_items", "column_configs": []},
    ]
    assert first["instructions"]["join_specs"] == DOC["instructions"]["join_specs"]
    assert first["instructions"]["example_question_sqls"] == DOC["instructions"]["example_question_sqls"]
    assert shown(model.to_documents(model.explode_model(again), again)) == shown(again)


def test_relations_of_one_pass_equal_those_of_each_list(spark, models):
    bare = spark.createDataFrame([(7, "{}"), (8, '{"version": 1, "data_sources": {"tables": [null, {"identifier": "t"}]}, "instructions": {"join_specs": []}}')], "model_id bigint, document string")
    docs = models.unionByName(model.read_documents(bare, "document"))
    direct, once = model.explode_model(docs), model.explode_model(docs, written=True)
    assert direct.keys() == once.keys()
    for name, frame in direct.items():
        assert frame.columns == once[name].columns
        rows = [sorted(map(str, f.collect())) for f in (frame, once[name])]
        assert rows[0] == rows[1], name
    plan = once["joins"]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "section" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_relations_of_no_documents(spark, models):
    assert all(f.count() == 0 for f in model.explode_model(models.limit(0), written=True).values())


def test_only_names_meet_their_references(spark, models):
    refs = spark.createDataFrame([(1, "orders")], "model_id bigint, table_ref string")
    plan = model.resolve_tables(refs, models)._jdf.queryExecution().optimizedPlan().toString()
    assert "column_configs" not in plan[: plan.index("Join")] and "identifier" in plan


def test_apply_then_validate(spark, models):
    relations, _ = model.apply_plan(models, make_fixes(spark, [
        {"fix_category": "metadata_add", "fix_type": "add_synonym", "table_ref": "orders", "column_name": "total", "synonym": "sales"},
        {"fix_category": "join_specs_delete", "fix_type": "delete_join_spec", "left_table": "main.s.orders", "right_table": "main.s.order_items"},
    ]))
    new = model.to_documents(relations, models)
    first = shown(new)[1]
    assert first["data_sources"]["tables"][0]["column_configs"][0]["synonyms"] == ["sum", "amount", "sales"]
    assert first["instructions"]["join_specs"] == []
    before, after = ({(r.model_id, r.message) for r in model.validate_models(d).collect()} for d in (models, new))
    assert {m for _, m in before - after} == {f"Join {'2' * 32} missing relationship type marker"} and not after - before


def test_diff_sees_added_removed_changed(spark, models):
    before = model.explode_model(models)
    after, _ = model.apply_plan(models, make_fixes(spark, [
        {"fix_category": "metadata_add", "fix_type": "add_table_description", "table_ref": "orders", "description": ["d"]},
        {"fix_category": "metadata_delete", "fix_type": "delete_synonym", "table_ref": "orders", "column_name": "total", "synonym": "sum"},
        {"fix_category": "metadata_add", "fix_type": "add_synonym", "table_ref": "orders", "column_name": "total", "synonym": "s"},
    ]))
    got = {(r.section, r.item, r.change) for r in model.diff_models(before, after).collect()}
    assert got == {("tables", "main.s.orders", "changed"), ("synonyms", "0/total/sum", "removed"), ("synonyms", "0/total/s", "added")}


def test_query_shapes_and_patterns(spark):
    texts = [
        ("select a from t where x in (1, 2, 3) and y = 'q'", "other"),
        ("SELECT a FROM t WHERE x IN (7) AND y = ''", "other"),
        ("with l as (select *, row_number() over (partition by id order by d desc) as rn from t) select * from l where rn = 1", "latest_record"),
        ("select k, sum(v) from t group by k order by 2 desc limit 5", "top_n"),
        ("select date_trunc('day', d), sum(v) from t group by date_trunc('day', d)", "trend"),
        ("select d from t where d >= current_date - interval 7 days", "date_range"),
    ]
    df = spark.createDataFrame(texts, "sql string, wanted string")
    got = mining.classify_patterns(df, "sql").collect()
    assert [r.pattern for r in got] == [w for _, w in texts]
    shapes = mining.fingerprint_queries(df.limit(2), "sql").collect()
    # literals and list lengths are no part of a shape
    assert [(s.queries, s.shape) for s in shapes] == [(2, "SELECT A FROM T WHERE X IN (?) AND Y = ?")]
    rules = {r.text for r in mining.mine_rules(df, "sql", 1).filter("kind = 'date_convention'").collect()}
    assert any("interval 7 days" in t.lower() for t in rules)


@pytest.mark.parametrize(
    "sql, expected",
    [
        ("select 1 from a join b on LEFT(a.x, 3) = b.y", {("a", "b", "left(a.x, 3) = b.y")}),
        ("select 1 from a x join b y on x.k = y.k and x.d >= y.d", {("a", "b", "a.k=b.k")}),
        ("select 1 from (select i from a join b on (i = (j))) s", {("a", "b", "(i = (j))")}),
        ("select 1 from a, b, c where a.x = c.x", {("a", "b", "cross"), ("a", "c", "a.x=c.x")}),
        ("select 1 from a left outer join s.b on f(g(h(a1))) = b1; select 2", {("a", "s.b", "f(g(h(a1))) = b1")}),
        ("select 1 from a join b using (k) join c on c.z between b.y and b.w", {("a", "b", "using(k)"), ("b", "c", "c.z between b.y and b.w")}),
        ("select 1 from a natural join b where 'join c on x = y' = a.t", {("a", "b", "cross")}),
        ("select a, b from t", set()),
    ],
)
def test_every_join_is_counted_once(spark, sql, expected):
    got = mining.mine_joins(spark.createDataFrame([(sql,)], "sql string"), "sql").collect()
    assert {(r.left_table, r.right_table, r.condition) for r in got} == expected and all(r.queries == 1 for r in got)


def written(spark, documents, fixes, **more):
    df = spark.createDataFrame(list(documents.items()), "id bigint, text string")
    models, report = model.update_documents(df, "text", make_fixes(spark, fixes), model_id="id", **more)
    return {r.id: r for r in models.collect()}, {(r.id, r.fix_id): (r.applied, r.reason) for r in report.collect()}


STRANGE = {
    "version": 1, "owner": {"a": [1, "x", None]}, "": "empty key", "quoted \"key\"": "line\nbreak é",
    "data_sources": {"catalog": "c", "tables": [
        {"identifier": "a.b.t", "tags": [True, 1.5], "column_configs": [
            {"column_name": "k", "format": {"digits": 2}, "synonyms": "not a list"}, {"column_name": "m"},
        ]},
    ]},
    "instructions": {"tone": "dry", "sql_functions": [{"id": "3" * 32, "identifier": "a.b.f", "cost": 7}],
        "example_question_sqls": [{"id": "1" * 32, "question": ["q"], "sql": ["s"], "parameters": [{"name": "p", "least": 0}]}],
        "join_specs": [{"id": "2" * 32, "left": {"identifier": "a.b.t", "alias": "t", "role": "fact"}, "right": {"identifier": "a.b.u", "alias": "u"},
                        "sql": ["x", model.RELATION_MARK + "ONE--"], "weight": 1}]},
    "config": {"sample_questions": [{"id": "4" * 32, "question": ["w"], "pin": True}], "language": "en"},
}


def without_empty(x):
    if isinstance(x, dict):
        return {k: without_empty(v) for k, v in x.items() if v not in ([], {"filters": [], "expressions": [], "measures": []})}
    return [without_empty(v) for v in x] if isinstance(x, list) else x


def test_other_keys_survive_the_relations(spark):
    df = spark.createDataFrame([(1, json.dumps(STRANGE)), (2, "{}"), (3, "no json"), (4, None)], "model_id bigint, d string")
    docs = materialize(model.read_documents(df, "d"), "models")
    again = model.write_documents(model.to_documents(model.explode_model(docs), docs))
    got = {r.model_id: without_empty(json.loads(r.document)) for r in again.collect()}
    assert got[1] == STRANGE
    assert set(got) == {1, 2, 3, 4}


def test_a_plan_is_applied_checked_and_written(spark):
    synonym = {"fix_category": "metadata_add", "fix_type": "add_synonym", "table_ref": "t", "column_name": "k", "synonym": "s"}
    broken = {**STRANGE, "version": 2}
    texts = {1: json.dumps(STRANGE), 2: json.dumps(broken), 3: json.dumps(STRANGE), 4: "no json", 5: None}
    fixes = [
        {**synonym, "model_id": 1}, {**synonym, "model_id": 2}, {**synonym, "model_id": 3, "table_ref": "nowhere"},
        {"model_id": 4, "fix_category": "instruction_fix", "fix_type": "update_text_instruction", "content": ["c"]},
    ]
    models, report = written(spark, texts, fixes)
    assert report == {
        (1, 0): (True, None), (2, 1): (False, model.REFUSED), (3, 2): (False, model.NO_TABLE), (4, 3): (False, model.REFUSED),
    }
    assert {i: (r.applied, r.failed, r.updated) for i, r in models.items()} == {
        1: (1, 0, True), 2: (0, 1, False), 3: (0, 1, False), 4: (0, 1, False), 5: (0, 0, False),
    }
    new = without_empty(json.loads(models[1].document))
    # the fix replaces the list that could not be read; all else stays
    wanted = json.loads(json.dumps(STRANGE))
    wanted["data_sources"]["tables"][0]["column_configs"][0]["synonyms"] = ["s"]
    assert new == wanted
    assert all(models[i].document == texts[i] for i in (2, 3, 4, 5))
    kept, dry = written(spark, {1: texts[1]}, [{**synonym, "model_id": 1}], dry_run=True)
    assert kept[1].document == texts[1] and (kept[1].applied, kept[1].updated) == (1, False) and dry == {(1, 0): (True, None)}
