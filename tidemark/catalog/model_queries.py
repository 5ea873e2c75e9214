"""Semantic-model maintenance: one document per customer, one fix per event.

Documents are built row by row from the customer table and fixes from the event
table; check queries state the opened documents and the fixes in SQL.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import joined_text
from tidemark.plans import model
from tidemark.registry import query
from tidemark.session import materialize, spread
from tidemark.views import Views


def _texts(*parts) -> Column:
    return F.array(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _struct(**fields) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()])


def documents_json(v: Views):
    """Model documents as JSON text; some carry old field names or broken parts."""
    n, seg, key = F.col("c_nationkey"), F.lower("c_mktsegment"), F.col("c_custkey").cast("string")

    def made(suffix: str) -> Column:
        return F.md5(F.concat(key, F.lit(suffix)))

    old = F.col("c_acctbal") < 0
    total = _struct(
        column_name="o_total",
        synonyms=_texts("amount", seg),
        get_example_values=F.when(old, True),
        enable_format_assistance=F.when(~old, False),
        format=_struct(kind="money", digits=2),
    )
    order_id = _struct(
        column_name="o_id",
        synonyms=_texts("id", "key"),
        get_example_values=F.lit(None).cast("boolean"),
        enable_format_assistance=F.lit(None).cast("boolean"),
        format=F.lit(None).cast("struct<kind:string,digits:int>"),
    )
    items = F.when(n == 3, F.concat(seg, F.lit(".items"))).otherwise(F.concat(F.lit("main."), seg, F.lit(".items")))
    item_columns = F.array(
        _struct(column_name=F.lit("name"), description=_texts("item name")),
        _struct(column_name=F.when(n != 9, "size"), description=F.lit(None).cast("array<string>")),
    )
    no_columns = F.array().cast("array<struct<column_name:string>>")
    tables = [
        _struct(identifier="main.shop.orders", description=_texts("orders"), column_configs=F.to_json(F.array(order_id, total))),
        _struct(identifier=items, description=F.lit(None).cast("array<string>"), column_configs=F.to_json(item_columns)),
        _struct(identifier=F.concat(F.lit("main.shop.N"), n.cast("string")), description=F.lit(None).cast("array<string>"), column_configs=F.to_json(no_columns)),
    ]
    # column lists differ in shape, so they are JSON texts put in place of their quotes
    shown_tables = F.concat_ws(",", *[
        F.concat(
            F.lit('{"identifier":"'), t["identifier"], F.lit('"'),
            F.coalesce(F.concat(F.lit(',"description":'), F.to_json(t["description"])), F.lit("")),
            F.lit(',"column_configs":'), t["column_configs"], F.lit(more), F.lit("}"),
        )
        for t, more in zip(tables, ['', ',"tags":["a",7,{"b":null}]', ',"description":"a text, not a list"'])
    ])
    text = _struct(id=made("t"), content=_texts("be exact"))
    texts = F.when(n == 5, F.array(text, _struct(id=made("t2"), content=_texts("be short")))).when(
        F.col("c_acctbal") > 0, F.array(text)
    )
    nation = n.cast("string")
    examples = F.array(
        _struct(id=F.when(n == 4, "bad").otherwise(made("e1")), question=_texts(F.concat(F.lit("total of "), seg)), sql=_texts("SELECT SUM(o_total) ", "FROM orders")),
        _struct(id=made("e2"), question=_texts(F.concat(F.lit("orders by nation "), nation)), sql=_texts(F.concat(F.lit("SELECT n, COUNT(o_id) FROM orders WHERE n = "), nation, F.lit(" GROUP BY n")))),
        _struct(id=made("e3"), question=_texts("orders by nation again"), sql=_texts("SELECT n, COUNT(o_id) FROM orders WHERE n = 99 GROUP BY n")),
    )
    snippets = _struct(
        filters=F.array(_struct(id=made("f"), sql=_texts("o_total > 10"), display_name="big orders")),
        expressions=F.array(_struct(id=made("x"), sql=_texts("MONTH(d)"), display_name="Month", alias="month")),
        measures=F.array(
            _struct(id=made("m"), sql=_texts("SUM(o_total)"), display_name="Total", alias="total"),
            _struct(id=made("m2"), sql=_texts("COUNT(1)"), display_name="Total", alias="n"),
        ),
    )
    mark = "--rt=FROM_RELATIONSHIP_TYPE_MANY_TO_ONE--"
    join_sql = F.when(n == 6, _texts("o.id = i.id ")).otherwise(_texts("o.id = i.id ", mark))
    joins = F.array(
        _struct(id=made("j"), left=_struct(identifier="main.shop.orders", alias="o", note=nation), right=_struct(identifier=items, alias="i"), sql=join_sql)
    )
    functions = F.when(n % 2 == 1, F.array(_struct(id=made("u"), identifier=F.concat(F.lit("main.udf.f"), nation))))
    instructions = F.to_json(
        _struct(text_instructions=texts, example_question_sqls=examples, sql_snippets=snippets, join_specs=joins, sql_functions=functions)
    )
    version = F.when(n == 7, '"version":2,').when(n == 8, "").otherwise('"version":1,')
    document = F.concat(
        F.lit("{"), version, F.lit('"data_sources":{"tables":['), shown_tables, F.lit(']},"instructions":'), instructions,
        F.lit(',"owner":{"team":"'), seg, F.lit('","size":'), nation, F.lit("}}"),
    )
    # customers are narrow and come in few row groups; a document takes far more work than its row
    held = spread(v.customer.select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal"))
    return held.select(F.col("c_custkey").alias("model_id"), document.alias("document"))


def documents(v: Views):
    return model.read_documents(documents_json(v), "document", more=False)


def stored_documents(v: Views):
    """Whole typed documents written once, for plans that read them many times."""
    return materialize(model.read_documents(documents_json(v), "document"), "models")


TYPES = [
    ("add_synonym", "metadata_add"), ("delete_synonym", "metadata_delete"), ("add_column_description", "metadata_add"),
    ("add_table_description", "metadata_add"), ("add_example_query", "sample_queries_add"),
    ("delete_example_query", "sample_queries_delete"), ("update_text_instruction", "instruction_fix"),
    ("add_filter", "sql_snippets_add"), ("delete_filter", "sql_snippets_delete"), ("add_expression", "sql_snippets_add"),
    ("delete_expression", "sql_snippets_delete"), ("add_measure", "sql_snippets_add"),
    ("delete_measure", "sql_snippets_delete"), ("add_join_spec", "join_specs_add"), ("delete_join_spec", "join_specs_delete"),
]


def fixes(v: Views):
    """One fix per event: the type cycles through all kinds, fields vary with the event number."""
    e, user = F.col("event_id"), F.col("user_id").cast("string")
    kind = e % len(TYPES)
    e_text = e.cast("string")

    def numbered(prefix: str, modulus: int) -> Column:
        return F.concat(F.lit(prefix), (e % modulus).cast("string"))

    def of(i: int, value) -> Column:
        return F.when(kind == i, value)

    fix_type, category = F, F
    for i, (t, c) in enumerate(TYPES):
        fix_type, category = fix_type.when(kind == i, t), category.when(kind == i, c)
    table_ref = F.coalesce(
        of(0, F.element_at(_texts("orders", "ITEMS", "shop.n", "nowhere"), (e % 4 + 1).cast("int"))),
        of(1, F.lit("orders")), of(2, F.lit("items")), of(3, F.when(e % 7 != 0, "main.shop.orders")),
    )
    column = F.coalesce(
        of(0, F.when(e % 7 < 3, "o_total").when(e % 7 < 5, "name").otherwise(numbered("new_", 2))),
        of(1, F.lit("o_total")), of(2, F.when(e % 2 == 0, "name").otherwise("extra")),
    )
    parameters = F.array(
        _struct(name="a", type_hint="LONG", description=_texts("first")),
        _struct(name="b", type_hint="weird", description=F.lit(None).cast("array<string>")),
        _struct(name="", type_hint="DATE", description=F.lit(None).cast("array<string>")),
    )
    columns = {
        "model_id": F.col("user_id"),
        "fix_id": e,
        "fix_category": F.when(e % 17 == 0, "metadata_add").when(e % 19 == 0, "no_such_category").otherwise(category),
        "fix_type": fix_type,
        "table_ref": table_ref,
        "column_name": column,
        "synonym": F.coalesce(of(0, numbered("s", 11)), of(1, F.when(e % 2 == 0, "amount").otherwise("zzz"))),
        "description": F.coalesce(of(2, _texts(F.concat(F.lit("d"), e_text))), of(3, _texts(F.concat(F.lit("t"), e_text)))),
        "content": of(6, F.when(e % 4 == 0, F.array().cast("array<string>")).otherwise(_texts(F.concat(F.lit("c"), e_text)))),
        "question": of(4, _texts(F.concat(F.lit("q"), e_text))),
        "sql": F.coalesce(
            of(4, _texts(F.concat(F.lit("SELECT "), e_text))), of(7, _texts(F.concat(F.lit("f"), e_text))),
            of(9, _texts("x")), of(11, F.when(e % 2 == 0, _texts("SUM(y)"))), of(13, _texts("a = b ")),
        ),
        "parameters": of(4, parameters),
        "ident": F.coalesce(
            of(10, F.when(e % 2 == 0, F.md5(F.concat(user, F.lit("x"))))), of(14, F.when(e % 2 == 0, F.md5(F.concat(user, F.lit("j"))))),
        ),
        "alias": F.coalesce(
            of(9, numbered("a", 4)), of(10, F.when(e % 2 == 1, "month")), of(11, numbered("m", 4)), of(12, F.when(e % 2 == 1, "n")),
        ),
        "display_name": F.coalesce(
            of(7, numbered("df", 4)), of(8, F.when(e % 2 == 0, "big orders").otherwise("none")), of(12, F.when(e % 2 == 0, "Total")),
        ),
        "pattern_name": F.coalesce(
            of(4, numbered("p", 4)),
            of(5, F.when(e % 4 == 0, "nation").when(e % 4 == 1, "total of").when(e % 4 == 2, "again").otherwise("absent")),
        ),
        "sql_expression": F.coalesce(of(7, numbered("x", 2)), of(9, numbered("x", 2)), of(11, numbered("x", 2))),
        "left_table": F.coalesce(of(13, F.lit("main.shop.orders")), of(14, F.when(e % 2 == 1, "main.shop.orders"))),
        "right_table": F.coalesce(
            of(13, F.when(e % 2 == 0, "main.shop.orders").otherwise("main.x.Part")), of(14, F.when(e % 2 == 1, "main.x.Part")),
        ),
        "on_clause": of(13, numbered("k", 2)),
    }
    wanted = {}
    for field in v.spark.createDataFrame([], model.FIX_COLUMNS).schema.fields:
        value = columns.get(field.name, F.lit(None))
        wanted[field.name] = value.cast(field.dataType).alias(field.name)
    # two narrow columns become wide fixes, which are sorted where they are read
    return spread(v.events.select("event_id", "user_id")).select(*wanted.values())


# -- the same fixes and documents for the check engine -------------------------------------

_TYPE_SQL = "case event_id % 15 " + " ".join(f"when {i} then '{t}'" for i, (t, _) in enumerate(TYPES)) + " end"
_CATEGORY_SQL = "case event_id % 15 " + " ".join(f"when {i} then '{c}'" for i, (_, c) in enumerate(TYPES)) + " end"

FIXES = f"""fx as (select user_id as model_id, event_id as fix_id, event_id % 15 as k, {_TYPE_SQL} as fix_type,
    case when event_id % 17 = 0 then 'metadata_add' when event_id % 19 = 0 then 'no_such_category' else {_CATEGORY_SQL} end as cat, {_CATEGORY_SQL} as own_cat,
    case event_id % 15 when 0 then ['orders', 'ITEMS', 'shop.n', 'nowhere'][event_id % 4 + 1] when 1 then 'orders' when 2 then 'items'
      when 3 then case when event_id % 7 <> 0 then 'main.shop.orders' end end as ref,
    case event_id % 15 when 0 then case when event_id % 7 < 3 then 'o_total' when event_id % 7 < 5 then 'name' else 'new_' || (event_id % 2) end
      when 1 then 'o_total' when 2 then case when event_id % 2 = 0 then 'name' else 'extra' end end as col,
    case event_id % 15 when 0 then 's' || (event_id % 11) when 1 then case when event_id % 2 = 0 then 'amount' else 'zzz' end end as syn,
    case event_id % 15 when 10 then case when event_id % 2 = 0 then md5(user_id || 'x') end when 14 then case when event_id % 2 = 0 then md5(user_id || 'j') end end as ident,
    case event_id % 15 when 9 then 'a' || (event_id % 4) when 10 then case when event_id % 2 = 1 then 'month' end when 11 then 'm' || (event_id % 4)
      when 12 then case when event_id % 2 = 1 then 'n' end end as alias_,
    case event_id % 15 when 7 then 'df' || (event_id % 4) when 8 then case when event_id % 2 = 0 then 'big orders' else 'none' end
      when 12 then case when event_id % 2 = 0 then 'Total' end end as disp,
    case event_id % 15 when 4 then 'p' || (event_id % 4) when 5 then ['nation', 'total of', 'again', 'absent'][event_id % 4 + 1] end as pat,
    'x' || (event_id % 2) as expr, case when event_id % 15 = 13 then 'main.shop.orders' when event_id % 15 = 14 and event_id % 2 = 1 then 'main.shop.orders' end as lt,
    case when event_id % 15 = 13 then case when event_id % 2 = 0 then 'main.shop.orders' else 'main.x.Part' end
         when event_id % 15 = 14 and event_id % 2 = 1 then 'main.x.Part' end as rt, 'k' || (event_id % 2) as onc
  from events),
 kx as (select *, case k when 0 then concat_ws('|', ref, col, syn) when 1 then concat_ws('|', ref, col, syn) when 2 then concat_ws('|', ref, col)
     when 3 then coalesce(ref, '?') when 4 then pat when 5 then pat when 6 then '' when 7 then disp || '|' || expr when 8 then disp
     when 9 then alias_ || '|' || expr when 10 then coalesce(alias_, ident) when 11 then alias_ || '|' || expr when 12 then coalesce(alias_, '-' || disp)
     when 13 then lt || '|' || rt || '|' || onc else coalesce(lt || '|' || rt, '-') end as same from fx),
 dd as (select * from (select *, row_number() over (partition by model_id, fix_type, same order by fix_id) as rn from kx) q where rn = 1),
 av as (select * from dd where cat = 'no_such_category' or cat = own_cat),
 pl as (select * from av where cat <> 'no_such_category')"""

DOCS = """mt as (select c_custkey as model_id, p as table_pos, case p when 0 then 'main.shop.orders'
      when 1 then case when c_nationkey = 3 then '' else 'main.' end || lower(c_mktsegment) || '.items' else 'main.shop.N' || c_nationkey end as identifier
    from customer, (select unnest([0, 1, 2])::integer as p) k),
  mc as (select c_custkey as model_id, t as table_pos, i as pos, case when t = 1 and i = 1 and c_nationkey = 9 then null else name end as column_name
    from customer, (values (0, 0, 'o_id'), (0, 1, 'o_total'), (1, 0, 'name'), (1, 1, 'size')) x(t, i, name)),
  ms as (select c_custkey as model_id, 0 as table_pos, c as column_name, i as pos, case when s = 'seg' then lower(c_mktsegment) else s end as synonym
    from customer, (values ('o_id', 0, 'id'), ('o_id', 1, 'key'), ('o_total', 0, 'amount'), ('o_total', 1, 'seg')) x(c, i, s))"""

RESOLVED = """rs as (select fix_id, (select min(t.table_pos) from mt t where t.model_id = f.model_id and (t.identifier = f.ref
     or lower(list_extract(string_split(t.identifier, '.'), -1)) = lower(f.ref) or contains(lower(t.identifier), lower(f.ref)))) as tp from pl f where k < 4)"""


@query("g05_dedupe_fixes", f"with {FIXES} select model_id, fix_id, fix_type from dd")
def g05(v):
    return model.dedupe_fixes(fixes(v)).select("model_id", "fix_id", "fix_type")


@query("l09_validate_fix_types", f"with {FIXES} select model_id, fix_id, fix_type, cat as fix_category from av")
def l09(v):
    return model.validate_fix_types(model.dedupe_fixes(fixes(v))).select("model_id", "fix_id", "fix_type", "fix_category")


ORDER_SQL = "list_position(['instruction_fix', 'join_specs_delete', 'join_specs_add', 'sql_snippets_delete', 'sql_snippets_add', 'metadata_delete', 'metadata_add', 'sample_queries_delete', 'sample_queries_add'], cat)"


@query("l10_order_fixes", f"with {FIXES} select model_id, fix_id, cast({ORDER_SQL} as integer) as apply_step from pl")
def l10(v):
    return planned(v).select("model_id", "fix_id", F.col("apply_step").cast("int").alias("apply_step"))


def planned(v):
    return model.order_fixes(model.validate_fix_types(model.dedupe_fixes(fixes(v))))


@query("l01_explode_tables", f"with {DOCS} select model_id, table_pos, identifier from mt")
def l01_tables(v):
    return model.explode_model(documents(v))["tables"].select("model_id", "table_pos", "identifier")


@query("l01_explode_columns", f"with {DOCS} select model_id, table_pos, pos, column_name from mc")
def l01_columns(v):
    return model.explode_model(documents(v))["columns"].select("model_id", "table_pos", "pos", "column_name")


@query(
    "l01_explode_examples",
    """select c_custkey as model_id, i as pos, case i when 0 then case when c_nationkey = 4 then 'bad' else md5(c_custkey || 'e1') end when 1 then md5(c_custkey || 'e2')
         else md5(c_custkey || 'e3') end as id, case i when 0 then 'total of ' || lower(c_mktsegment) when 1 then 'orders by nation ' || c_nationkey else 'orders by nation again' end as question
       from customer, (select unnest([0, 1, 2])::integer as i) k""",
)
def l01_examples(v):
    return model.explode_model(documents(v))["examples"].select(
        "model_id", "pos", "id", F.array_join("question", "").alias("question")
    )


@query(
    "l01_explode_functions",
    "select c_custkey as model_id, 0 as pos, md5(c_custkey || 'u') as id, 'main.udf.f' || c_nationkey as identifier from customer where c_nationkey % 2 = 1",
)
def l01_functions(v):
    return model.explode_model(documents(v))["functions"].select("model_id", "pos", "id", "identifier")


@query(
    "l01_unknown_keys",
    """select c_custkey as model_id, lower(c_mktsegment) as team, cast(c_nationkey as varchar) as size, '7' as tag, '2' as digits, cast(c_nationkey as varchar) as note,
         'a text, not a list' as description from customer""",
)
def l01_unknown_keys(v):
    """Keys without a field, read from documents that were written back from their relations."""
    docs = stored_documents(v)
    written = model.write_documents(model.to_documents(model.explode_model(docs), docs))
    paths = {
        "team": "$.owner.team", "size": "$.owner.size", "tag": "$.data_sources.tables[1].tags[1]",
        "digits": "$.data_sources.tables[0].column_configs[1].format.digits",
        "note": "$.instructions.join_specs[0].left.note", "description": "$.data_sources.tables[2].description",
    }
    return written.select("model_id", *[F.get_json_object("document", path).alias(name) for name, path in paths.items()])


@query("l01_text_round_trip", "select c_custkey as model_id, true as same from customer")
def l01_text_round_trip(v):
    """Whole texts against the texts written back from their relations; a missing list and an empty one are alike."""
    given = materialize(documents_json(v), "texts")
    docs = materialize(model.read_documents(given, "document"), "models")
    written = model.write_documents(model.to_documents(model.explode_model(docs), docs), "written")

    def canonical(c: str) -> Column:
        # objects of a variant have their keys in order
        shown = F.regexp_replace(F.to_json(F.parse_json(c)), r'"[a-z_]+":\[\],?', "")
        return F.regexp_replace(shown, r",\}", "}")

    both = given.join(written.hint("merge"), "model_id", "left")
    return both.select("model_id", (canonical("document").eqNullSafe(canonical("written"))).alias("same"))


@query(
    "l01_section_items",
    f"""with {DOCS}, n as (select model_id, 'tables' as section, count(*) as n from mt group by 1 union all select model_id, 'columns', count(*) from mc group by 1
          union all select model_id, 'synonyms', count(*) from ms group by 1 union all select c_custkey, 'examples', 3 from customer union all select c_custkey, 'snippets', 4 from customer
          union all select c_custkey, 'joins', 1 from customer union all select c_custkey, 'functions', 1 from customer where c_nationkey % 2 = 1 union all select c_custkey, 'instructions', case when c_nationkey = 5 then 2 else 1 end from customer where c_acctbal > 0 or c_nationkey = 5)
        select model_id, section, n as items, case section when 'tables' then (select string_agg(identifier, ' ' order by lower(identifier)) from mt where mt.model_id = n.model_id)
           when 'synonyms' then (select string_agg(synonym, ' ' order by lower(synonym)) from ms where ms.model_id = n.model_id) end as keys from n""",
)
def l01_items(v):
    items = model.section_items(model.explode_model(documents(v), written=True))
    shown = F.when(F.col("section") == "tables", F.get_json_object("item", "$.identifier")).when(
        F.col("section") == "synonyms", F.get_json_object("item", "$.synonym")
    )
    listed = F.array_sort(F.collect_list(F.struct("item_key", "added_by", "pos", shown.alias("k"))))
    grouped = items.groupBy("model_id", "section").agg(F.count(F.lit(1)).alias("items"), listed.alias("l"))
    named = F.col("section").isin("tables", "synonyms")
    return grouped.select(
        "model_id", "section", "items", F.when(named, F.array_join(F.transform("l", lambda x: x["k"]), " ")).alias("keys")
    )


@query("l01_round_trip", "select c_custkey as model_id, true as same from customer")
def l01_round_trip(v):
    """Documents written back from their relations, twice: the second time nothing changes, and no list loses an item."""
    docs = stored_documents(v)
    once = materialize(model.to_documents(model.explode_model(docs), docs), "models")
    twice = model.to_documents(model.explode_model(once), once)

    def text(df, name):
        kept = [c for c in df.columns if c != "model_id"]
        # a missing list and an empty one are alike
        shown = F.regexp_replace(F.to_json(F.struct(*kept)), r'"[a-z_]+":\[\],?', "")
        return df.select("model_id", F.regexp_replace(shown, r",\}", "}").alias(name))

    # whole texts on every side: joined by sorting, never broadcast
    given = text(model.canonical_sort(docs), "a").join(text(model.canonical_sort(once), "b").hint("merge"), "model_id")
    both = given.join(text(model.canonical_sort(twice), "c").hint("merge"), "model_id")
    return both.select("model_id", ((F.col("a") == F.col("b")) & (F.col("b") == F.col("c"))).alias("same"))


@query("l02_resolve_tables", f"with {FIXES}, {DOCS}, {RESOLVED} select distinct f.model_id, f.ref as table_ref, rs.tp as table_pos, mt.identifier from pl f join rs on rs.fix_id = f.fix_id left join mt on mt.model_id = f.model_id and mt.table_pos = rs.tp where f.ref is not null")
def l02(v):
    return model.resolve_tables(planned(v), documents(v))


def metadata_adds(v):
    docs = documents(v)
    return model.apply_metadata_adds(model.explode_model(docs), docs, planned(v))


_USABLE = f"""{FIXES}, {DOCS}, {RESOLVED}, us as (select pl.*, rs.tp from pl join rs on rs.fix_id = pl.fix_id where rs.tp is not null)"""


@query(
    "l03_metadata_adds_columns",
    f"""with {_USABLE}, n as (select model_id, tp as table_pos, col as column_name, min(fix_id) as added_by, max(case when k = 2 then fix_id end) as last from us where k in (0, 2) group by 1, 2, 3)
        select coalesce(mc.model_id, n.model_id) as model_id, coalesce(mc.table_pos, n.table_pos) as table_pos, coalesce(mc.column_name, n.column_name) as column_name, mc.pos,
          case when mc.model_id is null then n.added_by end as added_by, case when n.last is not null then 'd' || n.last when mc.column_name = 'name' then 'item name' end as description
        from mc full join n on n.model_id = mc.model_id and n.table_pos = mc.table_pos and n.column_name = mc.column_name""",
)
def l03_columns(v):
    changed = metadata_adds(v)[0]["columns"]
    return changed.select("model_id", "table_pos", "column_name", "pos", "added_by", F.get("description", F.lit(0)).alias("description"))


@query(
    "l03_metadata_adds_synonyms",
    f"""with {_USABLE}, n as (select model_id, tp as table_pos, col as column_name, syn as synonym, min(fix_id) as added_by from us where k = 0 group by 1, 2, 3, 4)
        select coalesce(ms.model_id, n.model_id) as model_id, coalesce(ms.table_pos, n.table_pos) as table_pos, coalesce(ms.column_name, n.column_name) as column_name,
          coalesce(ms.synonym, n.synonym) as synonym, case when ms.model_id is null then n.added_by end as added_by
        from ms full join n on n.model_id = ms.model_id and n.table_pos = ms.table_pos and n.column_name = ms.column_name and n.synonym = ms.synonym""",
)
def l03_synonyms(v):
    return metadata_adds(v)[0]["synonyms"].select("model_id", "table_pos", "column_name", "synonym", "added_by")


@query(
    "l03_metadata_adds_tables",
    f"""with {_USABLE}, n as (select model_id, tp, max(fix_id) as last from us where k = 3 group by 1, 2)
        select mt.model_id, mt.table_pos, identifier, case when n.last is not null then 't' || n.last when mt.table_pos = 0 then 'orders' end as description
        from mt left join n on n.model_id = mt.model_id and n.tp = mt.table_pos""",
)
def l03_tables(v):
    return metadata_adds(v)[0]["tables"].select("model_id", "table_pos", "identifier", F.get("description", F.lit(0)).alias("description"))


@query(
    "l04_metadata_deletes",
    f"""with {_USABLE}, d as (select distinct model_id, tp, col, syn from us where k = 1)
        select ms.model_id, ms.table_pos, ms.column_name, ms.synonym from ms left join d on d.model_id = ms.model_id and d.tp = ms.table_pos and d.col = ms.column_name and d.syn = ms.synonym
        where d.model_id is null""",
)
def l04(v):
    docs = documents(v)
    changed, _ = model.apply_metadata_deletes(model.explode_model(docs), docs, planned(v))
    return changed["synonyms"].select("model_id", "table_pos", "column_name", "synonym")


# deletes of examples in fix order: "nation" means example 2, "total of" example 1, "again" example 3
_DELETED_EXAMPLES = """dx as (select model_id, case pat when 'nation' then 1 when 'total of' then 0 when 'again' then 2 end as pos, min(fix_id) as fix_id from pl
    where k = 5 and pat <> 'absent' and model_id in (select c_custkey from customer) group by 1, 2)"""


@query(
    "l05_examples",
    f"""with {FIXES}, {_DELETED_EXAMPLES}, o as (select c_custkey as model_id, i as pos from customer, (select unnest([0, 1, 2])::integer as i) k)
        select o.model_id, o.pos, cast(null as bigint) as added_by, cast(null as varchar) as hints from o left join dx on dx.model_id = o.model_id and dx.pos = o.pos where dx.pos is null
        union all select model_id, null, fix_id, 'a:INTEGER b:' from pl where k = 4""",
)
def l05(v):
    docs = documents(v)
    changed, _ = model.apply_examples(model.explode_model(docs), docs, planned(v))
    hints = F.array_join(
        F.transform("parameters", lambda p: F.concat(p["name"], F.lit(":"), F.coalesce(p["type_hint"], F.lit("")))), " "
    )
    return changed["examples"].select("model_id", "pos", "added_by", F.when(F.col("added_by").isNotNull(), hints).alias("hints"))


@query(
    "l06_snippets",
    f"""with {FIXES}, o as (select c_custkey as model_id, kind, pos, md5(c_custkey || s) as id, alias_, disp from customer,
            (values ('filters', 0, 'f', null, 'big orders'), ('expressions', 0, 'x', 'month', 'Month'), ('measures', 0, 'm', 'total', 'Total'), ('measures', 1, 'm2', 'n', 'Total')) x(kind, pos, s, alias_, disp)),
          d as (select *, case k when 8 then 'filters' when 10 then 'expressions' else 'measures' end as kind from pl where k in (8, 10, 12))
        select o.model_id, o.kind, o.pos, o.alias_ as alias, o.disp as display_name, cast(null as bigint) as added_by from o
          where not exists (select 1 from d where d.model_id = o.model_id and d.kind = o.kind and (d.ident = o.id or d.alias_ = o.alias_ or d.disp = o.disp))
        union all select model_id, case k when 7 then 'filters' when 9 then 'expressions' else 'measures' end, null, case when k > 7 then alias_ end, coalesce(disp, 'Snippet'), fix_id
          from pl where k in (7, 9) or (k = 11 and fix_id % 2 = 0)""",
)
def l06(v):
    changed, _ = model.apply_snippets(model.explode_model(documents(v)), planned(v))
    return changed["snippets"].select("model_id", "kind", "pos", "alias", "display_name", "added_by")


@query(
    "l07_joins",
    f"""with {FIXES}, gone as (select distinct model_id from pl where k = 14 and ident is not null)
        select c_custkey as model_id, cast(null as bigint) as added_by, 'o' as left_alias, 'i' as right_alias, case when c_nationkey = 6 then 1 else 2 end as lines
          from customer where c_custkey not in (select model_id from gone)
        union all select model_id, fix_id, case when lt = rt then 'o1' else 'o' end, case when lt = rt then 'o2' else 'p' end, 2 from pl where k = 13""",
)
def l07(v):
    changed, _ = model.apply_joins(model.explode_model(documents(v)), planned(v))
    return changed["joins"].select("model_id", "added_by", "left_alias", "right_alias", F.size("sql").alias("lines"))


@query(
    "l08_instruction",
    f"""with {FIXES}, n as (select model_id, max(fix_id) as last, min(fix_id) as first from pl where k = 6 and fix_id % 4 <> 0 group by 1),
          o as (select c_custkey as model_id, i as pos from customer, (select unnest([0, 1])::integer as i) k where (i = 0 and (c_acctbal > 0 or c_nationkey = 5)) or (i = 1 and c_nationkey = 5))
        select o.model_id, o.pos, cast(null as bigint) as added_by, case when o.pos = 1 then 'be short' when n.last is not null then 'c' || n.last else 'be exact' end as content
          from o left join n on n.model_id = o.model_id
        union all select model_id, 0, first, 'c' || last from n where model_id not in (select model_id from o)""",
)
def l08(v):
    changed, _ = model.apply_instruction(model.explode_model(documents(v)), planned(v))
    return changed["instructions"].select("model_id", "pos", "added_by", F.array_join("content", " ").alias("content"))


_OUTCOMES = f"""with {_USABLE}, {_DELETED_EXAMPLES},
   fd as (select model_id, tp, col, syn, min(fix_id) as fix_id from us where k = 1 group by 1, 2, 3, 4),
   dsy as (select fd.fix_id from fd where exists (select 1 from ms where ms.model_id = fd.model_id and ms.table_pos = fd.tp and ms.column_name = fd.col and ms.synonym = fd.syn)),
   sn as (select c_custkey as model_id, kind, pos, md5(c_custkey || s) as id, alias_, disp from customer,
     (values ('8', 0, 'f', null, 'big orders'), ('10', 0, 'x', 'month', 'Month'), ('12', 0, 'm', 'total', 'Total'), ('12', 1, 'm2', 'n', 'Total')) x(kind, pos, s, alias_, disp)),
   ds as (select sn.model_id, sn.kind, sn.pos, min(d.fix_id) as fix_id from sn join pl d on d.model_id = sn.model_id and d.k::varchar = sn.kind
      and (d.ident = sn.id or d.alias_ = sn.alias_ or d.disp = sn.disp) group by 1, 2, 3),
   dj as (select model_id, min(fix_id) as fix_id from pl where k = 14 and ident is not null and model_id in (select c_custkey from customer) group by 1),
   oc as (select p.model_id, p.fix_id, p.fix_type, case when k in (0, 2, 3) then p.fix_id in (select fix_id from us) when k = 1 then p.fix_id in (select fix_id from dsy)
        when k in (4, 7, 9, 13) then true when k = 5 then p.fix_id in (select fix_id from dx) when k = 6 then p.fix_id % 4 <> 0 when k = 11 then p.fix_id % 2 = 0
        when k in (8, 10, 12) then p.fix_id in (select fix_id from ds) else p.fix_id in (select fix_id from dj) end as applied,
        case when k in (0, 2, 3) then case when ref is null then 'missing field' else 'table not found' end when k = 1 then case when p.fix_id in (select fix_id from us) then 'nothing matched' else 'table not found' end
          when k in (6, 11) then 'missing field' else 'nothing matched' end as why from pl p)"""


@query(
    "l11_apply_plan_outcomes",
    f"{_OUTCOMES} select model_id, fix_id, fix_type, applied, case when not applied then why end as reason from oc",
)
def l11(v):
    return model.apply_plan(stored_documents(v), fixes(v))[1]


@query(
    "l11_apply_plan_dry_run",
    f"with {DOCS} select model_id, count(*) as columns from mc group by 1",
)
def l11_dry(v):
    kept, _ = model.apply_plan(documents(v), fixes(v), dry_run=True)
    return kept["columns"].groupBy("model_id").agg(F.count(F.lit(1)).alias("columns"))


_UPDATED = f"""{_OUTCOMES}, un as (select model_id, count(*) filter (where applied) as a, count(*) filter (where not applied) as f from oc group by 1),
   st as (select c_custkey as model_id, c_nationkey as n, c_acctbal as bal, coalesce(a, 0) as a, coalesce(f, 0) as f,
       cast(case when c_nationkey in (3, 5, 7, 8, 9) or (c_nationkey = 4 and c_custkey not in (select model_id from dx where pos = 0)) then 1 else 0 end as bigint) as errors,
       cast(case when c_nationkey = 6 and c_custkey not in (select model_id from dj) then 1 else 0 end as bigint) as warnings
     from customer left join un on un.model_id = c_custkey),
   up as (select *, errors = 0 and a > 0 as updated from st),
   uc as (select distinct us.model_id, tp, col from us join up on up.model_id = us.model_id and updated where k in (0, 2)),
   ts as (select model_id, table_pos, column_name, synonym from ms union select us.model_id, tp, col, syn from us join up on up.model_id = us.model_id and updated where k = 0),
   hs as (select ts.* from ts left join up on up.model_id = ts.model_id
     where not updated or exists (select 1 from us where k = 0 and us.model_id = ts.model_id and us.tp = ts.table_pos and us.col = ts.column_name and us.syn = ts.synonym)
       or not exists (select 1 from us where k = 1 and us.model_id = ts.model_id and us.tp = ts.table_pos and us.col = ts.column_name and us.syn = ts.synonym))"""

_ADDED = "(select count(*) from pl where pl.model_id = up.model_id and updated and {})"


@query(
    "l11_update_models",
    f"""{_UPDATED} select model_id, case when errors = 0 then a else 0 end as applied, case when errors = 0 then f else a + f end as failed, errors, warnings, updated,
          4 + (select count(*) from uc where uc.model_id = up.model_id and not exists (select 1 from mc where mc.model_id = uc.model_id and mc.table_pos = uc.tp and mc.column_name = uc.col)) as columns,
          (select count(*) from hs where hs.model_id = up.model_id) as synonyms,
          3 - (select count(*) from dx where dx.model_id = up.model_id and updated) + {_ADDED.format("k = 4")} as examples,
          4 - (select count(*) from ds where ds.model_id = up.model_id and updated) + {_ADDED.format("(k in (7, 9) or (k = 11 and fix_id % 2 = 0))")} as snippets,
          1 - (select count(*) from dj where dj.model_id = up.model_id and updated) + {_ADDED.format("k = 13")} as joins,
          cast(case when n = 5 then 2 when bal > 0 or {_ADDED.format("k = 6 and fix_id % 4 <> 0")} > 0 then 1 else 0 end as bigint) as instructions,
          cast(n % 2 as bigint) as functions, lower(c_mktsegment) as team
        from up join customer on c_custkey = model_id""",
)
def l11_update(v):
    """The whole flow: texts read, fixes applied, results checked and written; items are counted in the new texts."""
    given = materialize(documents_json(v), "texts")
    models, _ = model.update_documents(given, "document", materialize(fixes(v), "fixes"))
    models = materialize(models, "updated")
    read = model.read_documents(models, "document", more=False)
    configs = F.flatten("data_sources.tables.column_configs")

    def items(*arrays) -> Column:
        return sum(F.coalesce(F.size(a), F.lit(0)) for a in arrays).cast("bigint")

    held = read.select(
        "model_id", items(configs).alias("columns"),
        F.aggregate(configs, F.lit(0).cast("bigint"), lambda n, c: n + items(c["synonyms"])).alias("synonyms"),
        items("instructions.example_question_sqls").alias("examples"),
        items(*[f"instructions.sql_snippets.{k}" for k in model.SNIPPET_KINDS.values()]).alias("snippets"),
        items("instructions.join_specs").alias("joins"), items("instructions.text_instructions").alias("instructions"),
        items("instructions.sql_functions").alias("functions"),
    )
    team = F.get_json_object("document", "$.owner.team").alias("team")
    return models.select("model_id", "applied", "failed", "errors", "warnings", "updated", team).join(held.hint("merge"), "model_id")


@query(
    "l11_update_outcomes",
    f"""{_UPDATED} select oc.model_id, fix_id, fix_type, applied and coalesce(errors, 0) = 0 as applied,
          case when not applied then why when errors > 0 then 'document not valid afterwards' end as reason from oc left join up on up.model_id = oc.model_id""",
)
def l11_outcomes(v):
    given = materialize(documents_json(v), "texts")
    return model.update_documents(given, "document", materialize(fixes(v), "fixes"))[1]


@query(
    "l11_update_dry_run",
    f"""{_UPDATED} select model_id, case when errors = 0 then a else 0 end as applied, case when errors = 0 then f else a + f end as failed, errors, warnings, false as updated,
          true as same from up""",
)
def l11_update_dry(v):
    given = materialize(documents_json(v), "texts")
    models, _ = model.update_documents(given, "document", materialize(fixes(v), "fixes"), dry_run=True)
    same = (F.col("g.document") == F.col("m.document")).alias("same")
    both = models.alias("m").join(given.alias("g").hint("merge"), "model_id")
    return both.select("model_id", "applied", "failed", "errors", "warnings", "updated", same)


@query(
    "l12_validate_models",
    """select c_custkey as model_id, 'error' as severity, 'Invalid table identifier: ' || lower(c_mktsegment) || '.items' as message from customer where c_nationkey = 3
       union all select c_custkey, 'error', 'Invalid UUID in instructions.example_question_sqls: bad' from customer where c_nationkey = 4
       union all select c_custkey, 'error', 'Maximum 1 text instruction allowed' from customer where c_nationkey = 5
       union all select c_custkey, 'warning', 'Join ' || md5(c_custkey || 'j') || ' missing relationship type marker' from customer where c_nationkey = 6
       union all select c_custkey, 'error', 'Invalid version: 2, expected 1' from customer where c_nationkey = 7
       union all select c_custkey, 'error', 'Missing required field: version' from customer where c_nationkey = 8
       union all select c_custkey, 'error', 'Column config missing column_name in main.' || lower(c_mktsegment) || '.items' from customer where c_nationkey = 9""",
)
def l12(v):
    return model.validate_models(documents(v))


@query(
    "l12_model_validity",
    """select c_custkey as model_id, cast(case when c_nationkey in (3, 4, 5, 7, 8, 9) then 1 else 0 end as bigint) as errors, cast(case when c_nationkey = 6 then 1 else 0 end as bigint) as warnings,
         c_nationkey not in (3, 4, 5, 7, 8, 9) as is_valid from customer""",
)
def l12_valid(v):
    return model.is_valid(documents(v))


@query(
    "l13_migrate_fields",
    """select c_custkey as model_id, c_acctbal < 0 as assisted, cast(null as boolean) as old_name from customer""",
)
def l13(v):
    moved = model.migrate_v1_v2(documents(v))
    column = F.col("data_sources.tables")[0]["column_configs"][1]
    return moved.select(
        "model_id", column["enable_format_assistance"].alias("assisted"), column["get_example_values"].alias("old_name")
    )


def versions(v):
    """Versions of a model from a customer's orders: the price is the score."""
    return v.orders.select(
        F.col("o_custkey").alias("model_id"), F.col("o_orderkey").alias("version"),
        F.col("o_totalprice").alias("score"), joined_text("o_orderstatus", "o_orderkey").alias("config"),
    )


@query(
    "l14_best_version",
    """select model_id, version, score, config from (select o_custkey as model_id, o_orderkey as version, o_totalprice as score, o_orderstatus || o_orderkey as config,
         row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn from orders) b where rn = 1""",
)
def l14(v):
    return model.best_version(versions(v))


@query(
    "l14_rollback",
    """with b as (select o_custkey as model_id, o_orderkey as version, o_totalprice as score, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn,
           row_number() over (partition by o_custkey order by o_orderkey desc) as newest from orders)
       select c.model_id, case when b.score > c.score then b.version else c.version end as version, greatest(b.score, c.score) as score, b.score > c.score as rolled_back
       from b c join b on b.model_id = c.model_id and b.rn = 1 where c.newest = 1""",
)
def l14_rollback(v):
    all_versions = versions(v)
    newest = F.max(F.struct("version", "score", "config")).alias("n")
    current = all_versions.groupBy("model_id").agg(newest).select("model_id", "n.*")
    return model.rollback_to(current, all_versions).drop("config")


@query(
    "l15_diff_models",
    f"""with {_USABLE}, n as (select model_id, tp as table_pos, col as column_name, max(case when k = 2 then fix_id end) as last from us where k in (0, 2) group by 1, 2, 3),
          sn as (select distinct model_id, tp, col, syn from us where k = 0)
        select n.model_id, 'columns' as section, n.table_pos || '/' || n.column_name as item, case when mc.model_id is null then 'added' else 'changed' end as change
          from n left join mc on mc.model_id = n.model_id and mc.table_pos = n.table_pos and mc.column_name = n.column_name where mc.model_id is null or n.last is not null
        union all select model_id, 'synonyms', tp || '/' || col || '/' || syn, 'added' from sn
        union all select distinct model_id, 'tables', 'main.shop.orders', 'changed' from us where k = 3""",
)
def l15(v):
    docs = stored_documents(v)
    before = model.explode_model(docs, written=True)
    after, _ = model.apply_metadata_adds(before, docs, materialize(planned(v), "fixes"))
    return model.diff_models(before, after)


@query(
    "f06_canonical_sort",
    """select c_custkey as model_id, case when 'main.' || lower(c_mktsegment) || '.items' < 'main.shop.n' or c_nationkey = 3 then
           case when c_nationkey = 3 and lower(c_mktsegment) || '.items' > 'main.shop.orders' then 'main.shop.N3 main.shop.orders ' || lower(c_mktsegment) || '.items'
                else case when c_nationkey = 3 then '' else 'main.' end || lower(c_mktsegment) || '.items main.shop.N' || c_nationkey || ' main.shop.orders' end end as tables,
         array_to_string(list_sort([case when c_nationkey = 4 then 'bad' else md5(c_custkey || 'e1') end, md5(c_custkey || 'e2'), md5(c_custkey || 'e3')]), ' ') as examples from customer""",
)
def f06(v):
    ordered = model.canonical_sort(documents(v))
    return ordered.select(
        "model_id",
        F.array_join(F.col("data_sources.tables.identifier"), " ").alias("tables"),
        F.array_join(F.col("instructions.example_question_sqls.id"), " ").alias("examples"),
    )
