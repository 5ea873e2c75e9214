"""Semantic-model maintenance over a table of many model documents.

Documents are opened into narrow relations, one row per table, column, synonym,
example, snippet, join or instruction. Fixes are applied to the relations with
joins and groupings keyed by (model, item): no model's fixes are gathered in one
place, so a model with a third of all fixes is spread over the cluster.

New items carry the fix that added them in ``added_by``; items of the document
have NULL there and keep their position in ``pos``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

from tidemark.functions.dates import to_col
from tidemark.functions.labels import position_in
from tidemark.functions.text import is_hex_id, is_three_part_name, last_name_part, stable_id
from tidemark.operators.filters import PARAMETER_TYPES, TYPE_HINT_ALIASES
from tidemark.operators.ranking import canonical_array
from tidemark.session import materialize

# at every level of a document: the keys the schema does not name, as the JSON text of one object
MORE = "__more"
_MORE = f"{MORE}:string"
_COLUMN = (
    "struct<column_name:string,description:array<string>,synonyms:array<string>,get_example_values:boolean,"
    f"build_value_dictionary:boolean,enable_format_assistance:boolean,enable_entity_matching:boolean,{_MORE}>"
)
_TABLE = f"struct<identifier:string,description:array<string>,column_configs:array<{_COLUMN}>,{_MORE}>"
_PARAMETER = f"struct<name:string,type_hint:string,description:array<string>,{_MORE}>"
_EXAMPLE = (
    f"struct<id:string,question:array<string>,sql:array<string>,parameters:array<{_PARAMETER}>,"
    f"usage_guidance:array<string>,{_MORE}>"
)
_SNIPPET = f"struct<id:string,sql:array<string>,display_name:string,synonyms:array<string>,alias:string,{_MORE}>"
_SIDE = f"struct<identifier:string,alias:string,{_MORE}>"
_JOIN = f"struct<id:string,left:{_SIDE},right:{_SIDE},sql:array<string>,comment:array<string>,{_MORE}>"
_TEXT = f"struct<id:string,content:array<string>,{_MORE}>"
_FUNCTION = f"struct<id:string,identifier:string,{_MORE}>"
_SNIPPETS = f"struct<filters:array<{_SNIPPET}>,expressions:array<{_SNIPPET}>,measures:array<{_SNIPPET}>,{_MORE}>"
_QUESTION = f"struct<id:string,question:array<string>,{_MORE}>"

DOCUMENT = (
    f"version int, data_sources struct<tables:array<{_TABLE}>,metric_views:array<{_TABLE}>,{_MORE}>, "
    f"instructions struct<text_instructions:array<{_TEXT}>,example_question_sqls:array<{_EXAMPLE}>,"
    f"sql_snippets:{_SNIPPETS},join_specs:array<{_JOIN}>,sql_functions:array<{_FUNCTION}>,{_MORE}>, "
    f"config struct<sample_questions:array<{_QUESTION}>,{_MORE}>, {MORE} string"
)

# Categories in the order they are applied.
APPLY_ORDER = [
    "instruction_fix", "join_specs_delete", "join_specs_add", "sql_snippets_delete", "sql_snippets_add",
    "metadata_delete", "metadata_add", "sample_queries_delete", "sample_queries_add",
]

# Fix types each category may hold.
ALLOWED_TYPES = {
    "instruction_fix": ["update_text_instruction"],
    "join_specs_add": ["add_join_spec"],
    "join_specs_delete": ["delete_join_spec"],
    "metadata_add": ["add_synonym", "add_column_description", "add_table_description"],
    "metadata_delete": ["delete_synonym"],
    "sample_queries_add": ["add_example_query"],
    "sample_queries_delete": ["delete_example_query"],
    "sql_snippets_add": ["add_filter", "add_expression", "add_measure"],
    "sql_snippets_delete": ["delete_filter", "delete_expression", "delete_measure"],
}

# The fields that make two fixes of a type the same fix.
SAME_FIX = {
    "add_synonym": ["table_ref", "column_name", "synonym"],
    "delete_synonym": ["table_ref", "column_name", "synonym"],
    "add_column_description": ["table_ref", "column_name"],
    "add_table_description": ["table_ref"],
    "add_example_query": ["pattern_name"],
    "delete_example_query": ["pattern_name", "ident"],
    "update_text_instruction": [],
    "add_filter": ["display_name", "sql_expression"],
    "delete_filter": ["display_name", "ident"],
    "add_expression": ["alias", "sql_expression"],
    "delete_expression": ["alias", "ident"],
    "add_measure": ["alias", "sql_expression"],
    "delete_measure": ["alias", "ident"],
    "add_join_spec": ["left_table", "right_table", "on_clause"],
    "delete_join_spec": ["left_table", "right_table"],
}

RELATION_MARK = "--rt=FROM_RELATIONSHIP_TYPE_"
SNIPPET_KINDS = {"filter": "filters", "expression": "expressions", "measure": "measures"}

FIX_COLUMNS = (
    "model_id bigint, fix_id bigint, fix_category string, fix_type string, table_ref string, column_name string, "
    "synonym string, synonyms array<string>, description array<string>, content array<string>, "
    "question array<string>, sql array<string>, usage_guidance array<string>, "
    "parameters array<struct<name:string,type_hint:string,description:array<string>>>, ident string, alias string, display_name string, pattern_name string, "
    "sql_expression string, on_clause string, left_table string, right_table string, left_alias string, "
    "right_alias string, relationship_type string, comment array<string>"
)


def _meet(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join of rows that both grow with the models, by sorting.

    Sizes of such sides are estimated from compressed files and fixed widths of
    texts and lists, so a side of whole documents would pass for a small one and
    be broadcast through the driver.
    """
    return left.join(right.hint("merge"), on, how)


# -- documents and relations -----------------------------------------------------------


def _nested(kind: DataType) -> bool:
    return isinstance(kind, StructType) or (isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType))


def _with_more(typed: Column, raw: Column, kind: DataType) -> Column:
    """A typed value with the keys of its raw value that the type does not hold.

    A named key whose value does not fit its type counts as one of them, so it
    is kept as it stands.
    """
    if isinstance(kind, ArrayType):
        items = F.try_variant_get(raw, "$", "array<variant>")
        return F.zip_with(typed, items, lambda x, r: F.when(x.isNotNull(), _with_more(x, r, kind.elementType)))
    named = [f for f in kind.fields if f.name != MORE]
    read = F.array_compact(F.array(*[F.when(typed[f.name].isNotNull(), F.lit(f.name)) for f in named]))
    known = F.array(*[F.lit(f.name) for f in named])
    others = F.map_filter(
        F.try_variant_get(raw, "$", "map<string,variant>"),
        lambda k, v: ~F.array_contains(read, k) & ~(F.array_contains(known, k) & F.is_variant_null(v)),
    )
    values = [
        F.when(typed[f.name].isNotNull(), _with_more(typed[f.name], F.try_variant_get(raw, f"$.{f.name}", "variant"), f.dataType))
        if _nested(f.dataType) else typed[f.name]
        for f in named
    ]
    more = F.when(F.size(others) > 0, F.to_json(others))
    return F.struct(*[v.alias(f.name) for v, f in zip(values, named)], more.alias(MORE))


def read_documents(df: DataFrame, c: str, model_id: str = "model_id", more: bool = True) -> DataFrame:
    """Typed documents from JSON text; keys without a field are kept as text in ``__more`` of their level.

    Text that is no JSON object gives a document without any field. Readers that
    do not write documents back can leave the other keys out (``more=False``).
    """
    if not more:
        return df.select(model_id, F.from_json(c, DOCUMENT).alias("d")).select(model_id, "d.*")
    kind = StructType.fromDDL(DOCUMENT)
    parsed = df.select(model_id, F.from_json(c, DOCUMENT).alias("d"), F.try_parse_json(c).alias("raw"))
    return parsed.select(model_id, _with_more(F.col("d"), F.col("raw"), kind).alias("d")).select(model_id, "d.*")


def _json_text(c: Column, kind: DataType) -> Column:
    """JSON text of a typed value, other keys in their place; fields without a value are left out."""
    if isinstance(kind, ArrayType) and _nested(kind):
        items = F.transform(c, lambda x: F.coalesce(_json_text(x, kind.elementType), F.lit("null")))
        return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))
    if isinstance(kind, ArrayType):
        return F.to_json(c)
    if isinstance(kind, StringType):
        return F.to_json(c.cast("variant"))
    if not isinstance(kind, StructType):
        return c.cast("string")
    more = F.from_json(c[MORE], "map<string,variant>")
    texts, names = [], []
    for f in kind.fields:
        if f.name == MORE:
            continue
        shown = c[f.name].isNotNull()
        if isinstance(f.dataType, ArrayType):
            # a list that could not be read has no items, but its text
            unread = F.coalesce(F.map_contains_key(more, f.name), F.lit(False))
            shown = shown & ~((F.size(c[f.name]) == 0) & unread)
        texts.append(F.when(shown, F.concat(F.lit(f'"{f.name}":'), _json_text(c[f.name], f.dataType))))
        names.append(F.when(shown, F.lit(f.name)))
    others = F.map_filter(more, lambda k, v: ~F.array_contains(F.array_compact(F.array(*names)), k))
    inner = F.when(F.size(others) > 0, F.regexp_replace(F.to_json(others), r"(?s)^\{(.*)\}$", "$1"))
    return F.when(c.isNotNull(), F.concat(F.lit("{"), F.array_join(F.array(*texts, inner), ","), F.lit("}")))


def write_documents(models: DataFrame, name: str = "document", model_id: str = "model_id") -> DataFrame:
    """Documents as JSON text, the counterpart of ``read_documents``."""
    kind = StructType.fromDDL(DOCUMENT)
    whole = F.struct(*[f.name for f in kind.fields]).alias("d")
    return models.select(model_id, whole).select(model_id, _json_text(F.col("d"), kind).alias(name))


# the lists of a document that become relations
LISTS = {
    "tables": "data_sources.tables",
    "examples": "instructions.example_question_sqls",
    "joins": "instructions.join_specs",
    **{kind: f"instructions.sql_snippets.{kind}" for kind in SNIPPET_KINDS.values()},
    "instructions": "instructions.text_instructions",
    "functions": "instructions.sql_functions",
}


def list_items(models: DataFrame) -> DataFrame:
    """Items of all lists from one pass: (model_id, section, pos, a column per list).

    An item stands, as it is in the document, in the column of its own list; the
    columns of the other lists are NULL.
    """
    kinds = models.select(*[F.col(path).alias(name) for name, path in LISTS.items()]).schema
    types = {f.name: f.dataType.elementType.simpleString() for f in kinds.fields}

    def of(section: str) -> Column:
        def placed(x: Column, i: Column) -> Column:
            own = {n: x if n == section else F.lit(None).cast(kind) for n, kind in types.items()}
            return F.struct(F.lit(section).alias("section"), i.alias("pos"), *[c.alias(n) for n, c in own.items()])

        listed = F.transform(F.col(LISTS[section]), placed)
        return F.coalesce(listed, F.filter(F.array(placed(F.lit(None).cast(types[section]), F.lit(0))), lambda _: F.lit(False)))

    return models.select("model_id", F.explode(F.concat(*[of(n) for n in LISTS])).alias("item")).select("model_id", "item.*")


def explode_model(models: DataFrame, written: bool = False) -> dict[str, DataFrame]:
    """The narrow relations of all documents.

    Each relation reads the documents. With ``written`` they are read once: the
    items of all lists go to the shared folder, a folder per list, and a relation
    opens the folder of its own list. Use it where several relations are wanted.
    """
    none = F.lit(None).cast("bigint").alias("added_by")
    items = materialize(list_items(models), "items", ["section"]) if written else None

    def opened(section: str) -> DataFrame:
        if items is None:
            # an outer explode: a plain one has documents parsed once more beforehand, ahead of any spread of the rows
            return models.select("model_id", F.posexplode_outer(LISTS[section]).alias("pos", "x")).filter("pos is not null")
        return items.filter(F.col("section") == section).select("model_id", "pos", F.col(section).alias("x"))

    tables = opened("tables").select(
        "model_id", F.col("pos").alias("table_pos"), "x.identifier", "x.description", "x.column_configs", f"x.{MORE}"
    )
    columns = tables.select("model_id", "table_pos", F.posexplode("column_configs").alias("pos", "x"))
    examples = opened("examples").select("model_id", "pos", none, "x.*")
    joins = opened("joins").select(
        "model_id", "pos", none, "x.id", F.col("x.left.identifier").alias("left_table"),
        F.col("x.left.alias").alias("left_alias"), F.col("x.right.identifier").alias("right_table"),
        F.col("x.right.alias").alias("right_alias"), "x.sql", "x.comment", f"x.{MORE}",
        F.col(f"x.left.{MORE}").alias("left_more"), F.col(f"x.right.{MORE}").alias("right_more"),
    )
    snippets = [
        opened(kind).select("model_id", F.lit(kind).alias("kind"), "pos", none, "x.*")
        for kind in SNIPPET_KINDS.values()
    ]
    return {
        "tables": tables.drop("column_configs"),
        "columns": columns.select(
            "model_id", "table_pos", "pos", none, "x.column_name", "x.description",
            "x.enable_format_assistance", "x.enable_entity_matching", "x.get_example_values", "x.build_value_dictionary",
            f"x.{MORE}",
        ),
        "synonyms": columns.select(
            "model_id", "table_pos", "x.column_name", F.posexplode("x.synonyms").alias("pos", "synonym"), none
        ),
        "examples": examples,
        "snippets": reduce(DataFrame.unionByName, snippets),
        "joins": joins,
        "instructions": opened("instructions").select("model_id", "pos", none, "x.*"),
        "functions": opened("functions").select("model_id", "pos", none, "x.*"),
    }


SECTION_KEY = {
    "tables": "identifier", "columns": "column_name", "synonyms": "synonym", "examples": "id", "snippets": "id",
    "joins": "id", "instructions": "id", "functions": "id",
}


def section_items(relations: dict[str, DataFrame]) -> DataFrame:
    """Relations as document items: (model_id, section, item_key, added_by, pos, item), a row per item.

    ``item_key``, ``added_by`` and ``pos`` give the canonical order of a section.
    """
    rows = None
    for section, frame in relations.items():
        kept = [c for c in frame.columns if c not in ("model_id", "pos", "added_by")]
        item = frame.select(
            "model_id", F.lit(section).alias("section"),
            F.lower(F.coalesce(F.col(SECTION_KEY[section]), F.lit(""))).alias("item_key"),
            F.coalesce("added_by", F.lit(-1)).alias("added_by") if "added_by" in frame.columns else F.lit(-1).cast("bigint").alias("added_by"),
            F.coalesce(F.col("pos"), F.lit(0)).alias("pos") if "pos" in frame.columns else F.col("table_pos").alias("pos"),
            F.to_json(F.struct(*kept)).alias("item"),
        )
        rows = item if rows is None else rows.unionByName(item)
    return rows


def _listed(frame: DataFrame, keys: list[str], item: Column, name: str) -> DataFrame:
    """Items of each key in document order: those that were there, then the added ones."""
    order = [F.coalesce(F.col(c), F.lit(-1)).alias(c) for c in ("added_by", "pos", "table_pos") if c in frame.columns and c not in keys]
    listed = F.array_sort(F.collect_list(F.struct(*order, item.alias("item"))))
    return frame.groupBy(*keys).agg(F.transform(listed, lambda s: s["item"]).alias(name))


def to_documents(relations: dict[str, DataFrame], models: DataFrame) -> DataFrame:
    """Documents written back from their relations.

    What has no relation (version, metric views, sample questions, other keys of
    a level) comes from ``models``; a list without items comes back empty. A document is one value
    by nature, so its items are gathered in its row.
    """
    place = ["model_id", "table_pos"]
    synonyms = _listed(relations["synonyms"], [*place, "column_name"], F.col("synonym"), "synonyms").alias("s")
    named = _meet(
        relations["columns"].alias("c"), synonyms, F.expr("c.model_id = s.model_id and c.table_pos = s.table_pos and c.column_name <=> s.column_name"), "left"
    ).select("c.*", "s.synonyms")
    config = F.struct(
        "column_name", "description", F.coalesce("synonyms", F.array().cast("array<string>")).alias("synonyms"),
        "get_example_values", "build_value_dictionary", "enable_format_assistance", "enable_entity_matching", MORE,
    )
    configs = _listed(named, place, config, "column_configs")
    tables = _meet(relations["tables"], configs, place, "left")
    table = F.struct("identifier", "description", F.coalesce("column_configs", F.array().cast(f"array<{_COLUMN}>")).alias("column_configs"), MORE)
    join = F.struct(
        "id", *[
            F.struct(
                F.col(f"{side}_table").alias("identifier"), F.col(f"{side}_alias").alias("alias"), F.col(f"{side}_more").alias(MORE)
            ).alias(side)
            for side in ("left", "right")
        ], "sql", "comment", MORE,
    )
    snippet = F.struct("id", "sql", "display_name", "synonyms", "alias", MORE)
    lists = {
        "tables": (tables, table, _TABLE),
        "text_instructions": (relations["instructions"], F.struct("id", "content", MORE), _TEXT),
        "example_question_sqls": (relations["examples"], F.struct("id", "question", "sql", "parameters", "usage_guidance", MORE), _EXAMPLE),
        "join_specs": (relations["joins"], join, _JOIN),
        "sql_functions": (relations["functions"], F.struct("id", "identifier", MORE), _FUNCTION),
    } | {kind: (relations["snippets"].filter(F.col("kind") == kind), snippet, _SNIPPET) for kind in SNIPPET_KINDS.values()}
    held = models
    for name, (frame, item, kind) in lists.items():
        held = _meet(held, _listed(frame, ["model_id"], item, f"__{name}"), "model_id", "left").withColumn(
            f"__{name}", F.coalesce(F.col(f"__{name}"), F.array().cast(f"array<{kind}>"))
        )
    kinds = F.struct(*[F.col(f"__{k}").alias(k) for k in SNIPPET_KINDS.values()], f"instructions.sql_snippets.{MORE}")
    source = F.struct(F.col("__tables").alias("tables"), "data_sources.metric_views", f"data_sources.{MORE}")
    instructions = F.struct(
        F.col("__text_instructions").alias("text_instructions"), F.col("__example_question_sqls").alias("example_question_sqls"),
        kinds.alias("sql_snippets"), F.col("__join_specs").alias("join_specs"), F.col("__sql_functions").alias("sql_functions"),
        f"instructions.{MORE}",
    )
    return held.withColumns({"data_sources": source, "instructions": instructions}).select(*models.columns)


def _columns_of(table: Column, change) -> Column:
    return table.withField("column_configs", F.transform(table["column_configs"], change))


def migrate_v1_v2(models: DataFrame) -> DataFrame:
    """Old field names of columns moved to the new ones; an old value replaces a new one."""

    def change(c: Column) -> Column:
        moved = c.withField(
            "enable_format_assistance", F.coalesce(c["get_example_values"], c["enable_format_assistance"])
        ).withField("enable_entity_matching", F.coalesce(c["build_value_dictionary"], c["enable_entity_matching"]))
        none = F.lit(None).cast("boolean")
        return moved.withField("get_example_values", none).withField("build_value_dictionary", none)

    source = F.col("data_sources")
    for name in ("tables", "metric_views"):
        source = source.withField(name, F.transform(F.col(f"data_sources.{name}"), lambda t: _columns_of(t, change)))
    return models.withColumn("data_sources", source)


def canonical_sort(models: DataFrame) -> DataFrame:
    """Documents with tables, columns, examples, joins and sample questions in canonical order."""

    def sorted_tables(name: str) -> Column:
        inner = F.transform(
            F.col(f"data_sources.{name}"),
            lambda t: t.withField("column_configs", canonical_array(t["column_configs"], "column_name")),
        )
        return canonical_array(inner, "identifier")

    source = F.col("data_sources").withField("tables", sorted_tables("tables")).withField(
        "metric_views", sorted_tables("metric_views")
    )
    instructions = F.col("instructions")
    for name in ("example_question_sqls", "join_specs"):
        instructions = instructions.withField(name, canonical_array(f"instructions.{name}", "id"))
    config = F.col("config").withField("sample_questions", canonical_array("config.sample_questions", "id"))
    return models.withColumns({"data_sources": source, "instructions": instructions, "config": config})


# -- fixes ---------------------------------------------------------------------------------


def dedupe_fixes(fixes: DataFrame) -> DataFrame:
    """First fix of every group of same fixes, per model.

    Types without a rule compare by all their fields.
    """
    fields = [c for c in fixes.columns if c not in ("model_id", "fix_id", "fix_category")]

    def joined(names: list[str]) -> Column:
        return F.to_json(F.struct("fix_type", *names), {"ignoreNullFields": "false"})

    key = F
    for fix_type, names in SAME_FIX.items():
        key = key.when(F.col("fix_type") == fix_type, joined(names))
    keyed = fixes.withColumn("__key", key.otherwise(joined([f for f in fields if f != "fix_type"])))
    first = F.min_by(F.struct(*fixes.columns), "fix_id").alias("f")
    return keyed.groupBy("model_id", "__key").agg(first).select("f.*")


def validate_fix_types(fixes: DataFrame) -> DataFrame:
    """Fixes whose type their category allows; an unknown category allows all."""
    allowed = F.create_map(*[x for k, v in ALLOWED_TYPES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    types = F.try_element_at(allowed, F.col("fix_category"))
    return fixes.filter(types.isNull() | F.array_contains(types, F.col("fix_type")))


def order_fixes(fixes: DataFrame) -> DataFrame:
    """Add the apply step of each fix; categories without a step are not applied."""
    step = position_in("fix_category", APPLY_ORDER)
    return fixes.withColumn("apply_step", step).filter(F.col("apply_step") <= len(APPLY_ORDER))


def resolve_tables(refs: DataFrame, models: DataFrame) -> DataFrame:
    """Position and identifier of the table each reference means, NULL for none.

    The first table of the document that matches exactly, by its last name part
    or by containing the reference wins. Distinct references meet their document
    once; its own table names, which are all that crosses the join, are searched in place.
    """
    distinct = refs.select("model_id", "table_ref").filter(F.col("table_ref").isNotNull()).distinct()
    listed = models.select("model_id", F.col("data_sources.tables.identifier").alias("names"))

    def fits(named: Column) -> Column:
        name, ref = named["identifier"], F.col("table_ref")
        part = F.lower(last_name_part(name))
        return (name == ref) | ((part != "") & (part == F.lower(ref))) | (
            (ref != "") & F.lower(name).contains(F.lower(ref))
        )

    numbered = F.transform(F.col("names"), lambda name, i: F.struct(i.alias("i"), name.alias("identifier")))
    found = _meet(distinct, listed, "model_id", "left").withColumn(
        "hit", F.get(F.filter(numbered, fits), F.lit(0))
    )
    return found.select(
        "model_id", "table_ref", F.col("hit.i").alias("table_pos"), F.col("hit.identifier").alias("identifier")
    )


def _filled(*names: str) -> Column:
    """All fields present and not empty."""
    result = F.lit(True)
    for name in names:
        c = F.col(name)
        result = result & F.coalesce(F.length(c.cast("string")) > 0, F.lit(False))
    return result


def _outcome(fixes: DataFrame, applied: Column, reason: Column) -> DataFrame:
    done = F.coalesce(applied, F.lit(False))
    return fixes.select("model_id", "fix_id", "fix_type", done.alias("applied"), F.when(~done, reason).alias("reason"))


def _judged(fixes: DataFrame, hits: DataFrame) -> DataFrame:
    """Mark the fixes (model_id, fix_id) that hit something; a fix is known by both, as ids restart per model."""
    hit = hits.select("model_id", "fix_id").distinct().withColumn("__hit", F.lit(True))
    return _meet(fixes, hit, ["model_id", "fix_id"], "left")


def _with_table(fixes: DataFrame, models: DataFrame) -> DataFrame:
    if "table_pos" in fixes.columns:
        return fixes
    return _meet(fixes, resolve_tables(fixes, models), ["model_id", "table_ref"], "left")


def _type(*names: str) -> Column:
    return F.col("fix_type").isin(*names)


MISSING, NO_TABLE, NOTHING = "missing field", "table not found", "nothing matched"
REFUSED = "document not valid afterwards"


def apply_metadata_adds(
    relations: dict[str, DataFrame], models: DataFrame, fixes: DataFrame
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Add synonyms, column descriptions and table descriptions (insert or replace).

    Of several descriptions of one target the latest fix counts.
    """
    mine = _with_table(fixes.filter(_type(*ALLOWED_TYPES["metadata_add"])), models)
    # an empty description is as good as none
    described = F.coalesce(F.exists("description", lambda d: F.length(d) > 0), F.lit(False))
    complete = (
        F.when(_type("add_synonym"), _filled("table_ref", "column_name", "synonym"))
        .when(_type("add_column_description"), _filled("table_ref", "column_name") & described)
        .otherwise(_filled("table_ref") & described)
    )
    usable = mine.filter(complete & F.col("table_pos").isNotNull())
    outcome = _outcome(
        mine, complete & F.col("table_pos").isNotNull(), F.when(complete, NO_TABLE).otherwise(MISSING)
    )
    no_text = F.lit(None).cast("array<string>")

    # existing rows count as fix -1: any fix is newer
    older = relations["columns"].withColumn("__fix", F.lit(-1).cast("bigint"))
    touched = usable.filter(_type("add_synonym", "add_column_description")).select(
        "model_id", "table_pos", "column_name", F.col("fix_id").alias("__fix"),
        F.when(_type("add_column_description"), F.col("description")).otherwise(no_text).alias("description"),
    )
    merged = older.unionByName(touched, allowMissingColumns=True)
    latest = F.max(F.when(F.col("description").isNotNull(), F.struct("__fix", "description")))["description"]
    first = F.min("__fix")
    columns = merged.groupBy("model_id", "table_pos", "column_name").agg(
        F.min("pos").alias("pos"),
        F.when(first >= 0, first).alias("added_by"),
        latest.alias("description"),
        *[F.max(c).alias(c) for c in ("enable_format_assistance", "enable_entity_matching", "get_example_values", "build_value_dictionary")],
        F.min_by(MORE, "pos").alias(MORE),
    )

    added = usable.filter(_type("add_synonym")).select(
        "model_id", "table_pos", "column_name", "synonym", F.col("fix_id").alias("added_by"),
        F.lit(None).cast("int").alias("pos"),
    )
    both = relations["synonyms"].unionByName(added)
    kept = F.min(F.struct(F.coalesce("added_by", F.lit(-1)).alias("a"), "pos", "added_by")).alias("m")
    synonyms = both.groupBy("model_id", "table_pos", "column_name", "synonym").agg(kept).select(
        "model_id", "table_pos", "column_name", "synonym", "m.pos", "m.added_by"
    )

    texts = usable.filter(_type("add_table_description")).groupBy("model_id", "table_pos").agg(
        F.max_by("description", "fix_id").alias("__new")
    )
    tables = _meet(relations["tables"], texts, ["model_id", "table_pos"], "left").withColumn(
        "description", F.coalesce("__new", "description")
    ).drop("__new")
    return {**relations, "columns": columns, "synonyms": synonyms, "tables": tables}, outcome


def apply_metadata_deletes(
    relations: dict[str, DataFrame], models: DataFrame, fixes: DataFrame
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Delete synonyms; of several fixes for one synonym the first one applies."""
    mine = _with_table(fixes.filter(_type("delete_synonym")), models)
    key = ["model_id", "table_pos", "column_name", "synonym"]
    complete = _filled("table_ref", "column_name", "synonym")
    first = mine.filter(complete).groupBy(*key).agg(F.min("fix_id").alias("__first"))
    hits = _meet(relations["synonyms"].select(*key).distinct(), first, key)
    judged = _judged(mine, hits.select("model_id", F.col("__first").alias("fix_id")))
    reason = F.when(~complete, MISSING).when(F.col("table_pos").isNull(), NO_TABLE).otherwise(NOTHING)
    outcome = _outcome(judged, F.col("__hit"), reason)
    kept = _meet(relations["synonyms"], hits.select(*key), key, "left_anti")
    return {**relations, "synonyms": kept}, outcome


def clean_parameters(c: str | Column) -> Column:
    """Template parameters with accepted type hints; unnamed ones are dropped."""
    aliases = F.create_map(*[F.lit(x) for pair in TYPE_HINT_ALIASES.items() for x in pair])

    def clean(p: Column) -> Column:
        asked = F.upper(F.coalesce(p["type_hint"], F.lit("")))
        hint = F.coalesce(F.try_element_at(aliases, asked), asked)
        return F.struct(
            p["name"].alias("name"),
            F.when(hint.isin(*PARAMETER_TYPES), hint).alias("type_hint"),
            F.coalesce(p["description"], F.array().cast("array<string>")).alias("description"),
            F.lit(None).cast("string").alias(MORE),
        )

    return F.transform(F.filter(to_col(c), lambda p: F.coalesce(p["name"], F.lit("")) != ""), clean)


def apply_examples(
    relations: dict[str, DataFrame], models: DataFrame, fixes: DataFrame
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Delete examples by question text or id, then add new ones.

    A delete takes the first example of the document whose question holds the
    pattern. Where several deletes mean the same example, the first one applies
    and the others report that nothing matched.
    """
    deletes = fixes.filter(_type("delete_example_query"))
    listed = models.select("model_id", F.col("instructions.example_question_sqls").alias("examples"))

    def fits(e: Column) -> Column:
        shown = F.coalesce(F.get(e["question"], F.lit(0)), F.lit(""))
        return shown.contains(F.col("pattern_name")) | (e["id"] == F.col("pattern_name"))

    wanted = deletes.filter(_filled("pattern_name")).groupBy("model_id", "pattern_name").agg(
        F.min("fix_id").alias("fix_id")
    )
    numbered = F.transform(F.col("examples"), lambda e, i: F.struct(i.alias("i"), e["id"].alias("id"), e["question"].alias("question")))
    aimed = _meet(wanted, listed, "model_id").withColumn("pos", F.get(F.filter(numbered, fits), F.lit(0))["i"])
    hits = aimed.filter(F.col("pos").isNotNull()).groupBy("model_id", "pos").agg(F.min("fix_id").alias("__first"))
    judged = _judged(deletes, hits.select("model_id", F.col("__first").alias("fix_id")))
    outcome = _outcome(
        judged, F.col("__hit"), F.when(_filled("pattern_name"), NOTHING).otherwise(MISSING)
    )
    old = relations["examples"]
    gone = hits.select("model_id", "pos")
    kept = _meet(old, gone, ["model_id", "pos"], "left_anti")

    adds = fixes.filter(_type("add_example_query"))
    added = adds.select(
        "model_id",
        F.lit(None).cast("int").alias("pos"),
        F.col("fix_id").alias("added_by"),
        stable_id("model_id", "fix_id").alias("id"),
        F.coalesce("question", F.array().cast("array<string>")).alias("question"),
        F.coalesce("sql", F.array().cast("array<string>")).alias("sql"),
        clean_parameters("parameters").alias("parameters"),
        "usage_guidance",
    )
    return (
        {**relations, "examples": kept.unionByName(added, allowMissingColumns=True)},
        outcome.unionByName(_outcome(adds, F.lit(True), F.lit(None).cast("string"))),
    )


def _first_delete(items: DataFrame, deletes: DataFrame, keys: list[dict[str, str]], scope: list[str]) -> DataFrame:
    """Which delete fix removes each item: (scope, pos, fix_id).

    ``keys`` lists ways to match, each {item column: fix column}. Fixes are
    reduced to the first per key value, so an item meets one fix per way.
    """
    found = None
    for way in keys:
        names = list(way)
        usable = deletes
        for fix_column in way.values():
            usable = usable.filter(F.coalesce(F.col(fix_column), F.lit("")) != "")
        first = usable.groupBy(*scope, *[F.col(f).alias(i) for i, f in way.items()]).agg(F.min("fix_id").alias("fix_id"))
        hit = _meet(items.select(*scope, "pos", *names), first, [*scope, *names]).select(*scope, "pos", "fix_id")
        found = hit if found is None else found.unionByName(hit)
    return found.groupBy(*scope, "pos").agg(F.min("fix_id").alias("fix_id"))


def _delete_outcome(deletes: DataFrame, removed: DataFrame, complete: Column) -> DataFrame:
    judged = _judged(deletes, removed.select("model_id", "fix_id"))
    return _outcome(judged, F.col("__hit"), F.when(complete, NOTHING).otherwise(MISSING))


def apply_snippets(
    relations: dict[str, DataFrame], fixes: DataFrame
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Delete snippets by id, alias or display name, then add new ones."""
    kind = F
    for word, name in SNIPPET_KINDS.items():
        kind = kind.when(F.col("fix_type").endswith(word), name)
    typed = fixes.withColumn("kind", kind)
    deletes = typed.filter(_type(*ALLOWED_TYPES["sql_snippets_delete"]))
    scope = ["model_id", "kind"]
    old = relations["snippets"]
    removed = _first_delete(
        old, deletes, [{"id": "ident"}, {"alias": "alias"}, {"display_name": "display_name"}], scope
    )
    named = _filled("ident") | _filled("alias") | _filled("display_name")
    outcome = _delete_outcome(deletes, removed, named)
    kept = _meet(old, removed.select(*scope, "pos"), [*scope, "pos"], "left_anti")

    adds = typed.filter(_type(*ALLOWED_TYPES["sql_snippets_add"]))
    has_sql = F.coalesce(F.size("sql"), F.lit(0)) > 0
    added = adds.filter(has_sql).select(
        "model_id",
        "kind",
        F.lit(None).cast("int").alias("pos"),
        F.col("fix_id").alias("added_by"),
        stable_id("model_id", "fix_id").alias("id"),
        "sql",
        F.coalesce("display_name", F.lit("Snippet")).alias("display_name"),
        F.when(F.size("synonyms") > 0, F.col("synonyms")).alias("synonyms"),
        F.when(F.col("kind") != "filters", F.col("alias")).alias("alias"),
    )
    return (
        {**relations, "snippets": kept.unionByName(added, allowMissingColumns=True)},
        outcome.unionByName(_outcome(adds, has_sql, F.lit(MISSING))),
    )


def apply_joins(relations: dict[str, DataFrame], fixes: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Delete joins by id or table pair, then add new ones with aliases and marker."""
    deletes = fixes.filter(_type("delete_join_spec"))
    old = relations["joins"]
    removed = _first_delete(
        old, deletes, [{"id": "ident"}, {"left_table": "left_table", "right_table": "right_table"}], ["model_id"]
    )
    named = _filled("ident") | _filled("left_table", "right_table")
    outcome = _delete_outcome(deletes, removed, named)
    kept = _meet(old, removed.select("model_id", "pos"), ["model_id", "pos"], "left_anti")

    adds = fixes.filter(_type("add_join_spec"))
    complete = _filled("left_table", "right_table") & (F.coalesce(F.size("sql"), F.lit(0)) > 0)

    def alias(given: str, table: str) -> Column:
        made = F.lower(F.substring(last_name_part(F.col(table)), 1, 1))
        return F.coalesce(F.when(F.col(given) != "", F.col(given)), made)

    left, right = alias("left_alias", "left_table"), alias("right_alias", "right_table")
    same = F.col("left_table") == F.col("right_table")
    marked = F.exists("sql", lambda s: s.contains("--rt="))
    kind = F.coalesce("relationship_type", F.lit("MANY_TO_ONE"))
    marker = F.concat(F.lit(RELATION_MARK), kind, F.lit("--"))
    added = adds.filter(complete).select(
        "model_id",
        F.lit(None).cast("int").alias("pos"),
        F.col("fix_id").alias("added_by"),
        stable_id("model_id", "fix_id").alias("id"),
        "left_table",
        F.when(same, F.concat(left, F.lit("1"))).otherwise(left).alias("left_alias"),
        "right_table",
        F.when(same, F.concat(left, F.lit("2"))).otherwise(right).alias("right_alias"),
        F.when(marked, F.col("sql")).otherwise(F.array_append("sql", marker)).alias("sql"),
        "comment",
    )
    return (
        {**relations, "joins": kept.unionByName(added, allowMissingColumns=True)},
        outcome.unionByName(_outcome(adds, complete, F.lit(MISSING))),
    )


def apply_instruction(relations: dict[str, DataFrame], fixes: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Replace the text instruction, or add one; the latest fix counts."""
    mine = fixes.filter(_type("update_text_instruction"))
    complete = F.coalesce(F.size("content"), F.lit(0)) > 0
    latest = mine.filter(complete).groupBy("model_id").agg(
        F.max_by("content", "fix_id").alias("__new"), F.min("fix_id").alias("__by")
    )
    old = relations["instructions"]
    replaced = _meet(old, latest.select("model_id", "__new"), "model_id", "left").withColumn(
        "content", F.when((F.col("pos") == 0) & F.col("__new").isNotNull(), F.col("__new")).otherwise(F.col("content"))
    ).drop("__new")
    fresh = _meet(latest, old.select("model_id"), "model_id", "left_anti").select(
        "model_id",
        F.lit(0).alias("pos"),
        F.col("__by").alias("added_by"),
        stable_id("model_id", "__by").alias("id"),
        F.col("__new").alias("content"),
    )
    return {**relations, "instructions": replaced.unionByName(fresh, allowMissingColumns=True)}, _outcome(mine, complete, F.lit(MISSING))


def apply_plan(
    models: DataFrame, fixes: DataFrame, dry_run: bool = False
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Apply deduplicated, allowed fixes in order; also returns one outcome row per fix.

    Deletes of a kind come before its adds, and kinds do not read each other, so
    each kind is one set-based step. A dry run reports outcomes and leaves the
    relations as they are.
    """
    known = [t for types in ALLOWED_TYPES.values() for t in types]
    # read by every step: written once, with the tables they mean, rather than deduplicated for each
    planned = materialize(_with_table(order_fixes(validate_fix_types(dedupe_fixes(fixes))), models), "planned-fixes")
    before = explode_model(models, written=True)
    relations, outcomes = before, []
    for step in (
        lambda r: apply_instruction(r, planned),
        lambda r: apply_joins(r, planned),
        lambda r: apply_snippets(r, planned),
        lambda r: apply_metadata_deletes(r, models, planned),
        lambda r: apply_metadata_adds(r, models, planned),
        lambda r: apply_examples(r, models, planned),
    ):
        relations, outcome = step(relations)
        outcomes.append(outcome)
    unknown = planned.filter(~F.col("fix_type").isin(*known))
    outcomes.append(_outcome(unknown, F.lit(False), F.lit("unknown fix type")))
    report = reduce(DataFrame.unionByName, outcomes)
    return (before if dry_run else relations), report


def update_documents(
    df: DataFrame, c: str, fixes: DataFrame, dry_run: bool = False, model_id: str = "model_id"
) -> tuple[DataFrame, DataFrame]:
    """Apply a plan to JSON documents, check the results and write back what passes.

    ``df`` has one row per model. Returns one row per model (applied, failed,
    errors, warnings, updated, document) and one outcome row per fix. A changed
    document takes the new field names and the canonical order. One that breaks
    a rule after its fixes is not written: the model keeps its text, and the
    fixes count as failed. So does every model in a dry run, whose outcomes and
    errors are those the plan would have. Models without an applied fix and
    texts that are no documents stay as they are.
    """
    texts = df.select(F.col(model_id).alias("model_id"), F.col(c).alias("__text"))
    before = materialize(read_documents(texts, "__text"), "models")
    relations, outcomes = apply_plan(before, fixes)
    report = materialize(outcomes, "outcomes")
    after = materialize(canonical_sort(migrate_v1_v2(to_documents(relations, before))), "models")
    counts = report.groupBy("model_id").agg(
        F.count_if("applied").alias("applied"), F.count_if(~F.col("applied")).alias("failed")
    )
    judged = _meet(is_valid(after), counts, "model_id", "left").na.fill(0, ["applied", "failed"])
    sound, wanted = F.col("is_valid"), F.col("applied") > 0
    readable = F.coalesce(F.schema_of_variant(F.try_parse_json("__text")).startswith("OBJECT"), F.lit(False))
    state = materialize(
        _meet(texts, judged, "model_id").select(
            "model_id", F.when(sound, F.col("applied")).otherwise(0).alias("applied"),
            F.when(sound, F.col("failed")).otherwise(F.col("failed") + F.col("applied")).alias("failed"), "errors", "warnings",
            (sound & wanted & readable & F.lit(not dry_run)).alias("updated"), (wanted & ~sound).alias("rejected"), "__text",
        ),
        "states",
    )
    written = write_documents(_meet(after, state.filter("updated").select("model_id"), "model_id", "left_semi"))
    models = _meet(state, written, "model_id", "left").select(
        F.col("model_id").alias(model_id), "applied", "failed", "errors", "warnings", "updated",
        F.coalesce("document", "__text").alias("document"),
    )
    refused = state.filter("rejected").select("model_id", F.lit(True).alias("__refused"))
    lost = F.col("applied") & F.col("__refused").isNotNull()
    final = _meet(report, refused, "model_id", "left").select(
        F.col("model_id").alias(model_id), "fix_id", "fix_type", (F.col("applied") & ~lost).alias("applied"),
        F.when(lost, REFUSED).otherwise(F.col("reason")).alias("reason"),
    )
    return models, final


# -- checks, versions and differences ----------------------------------------------------


def validate_models(models: DataFrame) -> DataFrame:
    """Rule violations as (model_id, severity, message) rows.

    Every rule adds its messages to one array per document, so the documents
    are scanned once however many rules there are.
    """

    def problem(severity: str, condition: Column, *message) -> Column:
        text = F.concat(*[F.coalesce(to_col(m) if isinstance(m, Column) else F.lit(m), F.lit("?")) for m in message])
        found = F.array(F.struct(F.lit(severity).alias("severity"), text.alias("message")))
        none = F.array().cast("array<struct<severity:string,message:string>>")
        return F.when(F.coalesce(condition, F.lit(False)), found).otherwise(none)

    def each(array: str, check) -> Column:
        listed = F.flatten(F.transform(F.col(array), check))
        return F.coalesce(listed, F.array().cast("array<struct<severity:string,message:string>>"))

    def bad_name(what: str):
        return lambda t: problem(
            "error", ~is_three_part_name(t["identifier"]), f"Invalid {what} identifier: ", t["identifier"]
        )

    def unnamed(t: Column) -> Column:
        return F.coalesce(
            F.flatten(
                F.transform(
                    t["column_configs"],
                    lambda c: problem(
                        "error", c["column_name"].isNull(), "Column config missing column_name in ", t["identifier"]
                    ),
                )
            ),
            F.array().cast("array<struct<severity:string,message:string>>"),
        )

    def join_rules(j: Column) -> Column:
        unmarked = ~F.exists(j["sql"], lambda s: s.contains(RELATION_MARK))
        return F.concat(
            problem("error", j["id"].isNull(), "Join spec missing id"),
            problem("error", j["left"].isNull() | j["right"].isNull(), "Join spec missing left or right"),
            problem("error", j["sql"].isNull(), "Join spec missing sql"),
            problem("warning", unmarked, "Join ", j["id"], " missing relationship type marker"),
        )

    def bad_ids(array: str) -> Column:
        return each(
            array,
            lambda x: problem(
                "error", x["id"].isNotNull() & ~is_hex_id(x["id"]), f"Invalid UUID in {array}: ", x["id"]
            ),
        )

    version = F.col("version")
    rules = [
        problem("error", version.isNull(), "Missing required field: version"),
        problem("error", version != 1, "Invalid version: ", version.cast("string"), ", expected 1"),
        each("data_sources.tables", bad_name("table")),
        each("data_sources.tables", unnamed),
        each("data_sources.metric_views", bad_name("metric view")),
        problem("error", F.size("instructions.text_instructions") > 1, "Maximum 1 text instruction allowed"),
        each("instructions.join_specs", join_rules),
        bad_ids("config.sample_questions"),
        bad_ids("instructions.text_instructions"),
        bad_ids("instructions.example_question_sqls"),
        bad_ids("instructions.join_specs"),
    ]
    return models.select("model_id", F.explode(F.concat(*rules)).alias("p")).select("model_id", "p.*")


def is_valid(models: DataFrame) -> DataFrame:
    """Each model with its error and warning counts."""
    counts = validate_models(models).groupBy("model_id").agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
    )
    joined = _meet(models.select("model_id"), counts, "model_id", "left").na.fill(0, ["errors", "warnings"])
    return joined.withColumn("is_valid", F.col("errors") == 0)


def best_version(versions: DataFrame) -> DataFrame:
    """The version to keep per model: best score, the earlier one on equal scores."""
    order = F.struct((-F.col("score")).alias("s"), "version")
    best = F.min_by(F.struct("version", "score", "config"), order).alias("b")
    return versions.filter(F.col("score").isNotNull()).groupBy("model_id").agg(best).select("model_id", "b.*")


def rollback_to(current: DataFrame, versions: DataFrame) -> DataFrame:
    """Current models with a worse score than their best version set back to it."""
    best = best_version(versions).select(
        "model_id", F.col("version").alias("bv"), F.col("score").alias("bs"), F.col("config").alias("bc")
    )
    joined = current.join(best, "model_id", "left")
    back = F.coalesce(F.col("bs") > F.col("score"), F.lit(False))
    return joined.select(
        "model_id",
        F.when(back, F.col("bv")).otherwise(F.col("version")).alias("version"),
        F.when(back, F.col("bs")).otherwise(F.col("score")).alias("score"),
        F.when(back, F.col("bc")).otherwise(F.col("config")).alias("config"),
        back.alias("rolled_back"),
    )


# columns that identify an item within its model
ITEM_KEYS = {
    "tables": ["identifier"], "columns": ["table_pos", "column_name"],
    "synonyms": ["table_pos", "column_name", "synonym"], "examples": ["id"], "snippets": ["kind", "id"],
    "joins": ["id"], "instructions": ["id"], "functions": ["id"],
}


def diff_models(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """Items added, removed or changed between two states: (model_id, section, item, change).

    One grouping over both states stands for a full outer join per section.
    """
    rows = None
    for section, keys in ITEM_KEYS.items():
        for state, frames in ((0, before), (1, after)):
            frame = frames[section]
            kept = sorted(c for c in frame.columns if c not in ("model_id", "pos", "added_by"))
            item = frame.select(
                "model_id",
                F.lit(section).alias("section"),
                F.concat_ws("/", *keys).alias("item"),
                F.lit(state).alias("state"),
                F.xxhash64(F.to_json(F.struct(*kept))).alias("digest"),
            )
            rows = item if rows is None else rows.unionByName(item)
    old, new = F.col("state") == 0, F.col("state") == 1
    sides = rows.groupBy("model_id", "section", "item").agg(
        F.count_if(old).alias("o"), F.count_if(new).alias("n"),
        F.sum(F.when(old, F.col("digest").cast("decimal(20,0)"))).alias("od"),
        F.sum(F.when(new, F.col("digest").cast("decimal(20,0)"))).alias("nd"),
    )
    change = F.when(F.col("o") == 0, "added").when(F.col("n") == 0, "removed").when(
        ~F.col("od").eqNullSafe(F.col("nd")), "changed"
    )
    return sides.withColumn("change", change).filter(F.col("change").isNotNull()).select(
        "model_id", "section", "item", "change"
    )
