"""Patterns mined from the stand-in query texts and model documents."""

from pyspark.sql import functions as F

from tidemark.catalog.model_queries import DOCS, documents
from tidemark.plans import mining, model
from tidemark.registry import query
from tidemark.session import spread

# the query text is assembled from a part's fields, so its pieces are known
_SHAPE = """'SELECT ' || upper(split_part(p_brand, '#', 1)) || '#?, SUM(X' || (p_size % 3) || ') FROM T' || (p_size % 5) || ' JOIN D' || (p_size % 4) || ' ON T' || (p_size % 5) || '.K = D' || (p_size % 4) ||
   '.K WHERE SIZE = ? AND KIND = ? GROUP BY ?' || case when p_size % 2 = 0 then ' ORDER BY ? DESC LIMIT ?' else '' end"""


@query(
    "n01_fingerprint_queries",
    f"""select md5({_SHAPE}) as fingerprint, {_SHAPE} as shape, count(*) as queries, min(sql) as example from sql_text join part on p_partkey = query_id group by 1, 2""",
)
def n01(v):
    return mining.fingerprint_queries(v.sql_text, "sql")


@query(
    "n02_pattern_counts",
    "select case when p_size % 2 = 0 then 'top_n' else 'join_aggregate' end as pattern, count(*) as queries from part group by 1",
)
def n02(v):
    return mining.pattern_counts(v.sql_text, "sql")


@query(
    "n03_mine_rules",
    """with r as (select 'size = ' || p_size as text from part union all select 'kind = ''' || p_type || '''' from part
         union all select 't' || (p_size % 5) || '.k = d' || (p_size % 4) || '.k' from part where false)
       select 'default_filter' as kind, text, count(*) as queries from r group by 2 having count(*) >= 5""",
)
def n03(v):
    return mining.mine_rules(v.sql_text, "sql", 5)


@query(
    "n04_mine_synonyms",
    """with t as (select p_partkey as q, unnest(list_distinct(list_filter(regexp_split_to_array(lower('total x' || (p_size % 3) || ' by ' || p_name || ' for ' || p_type), '[^\\p{L}\\p{N}_]+'), lambda w: length(w) > 1))) as term,
              'x' || (p_size % 3) as c from part),
       b as (select term, c, count(*) as n from t group by 1, 2 having count(*) >= 2), tc as (select term, count(*) as n from t group by 1), cc as (select 'x' || (p_size % 3) as c, count(*) as n from part group by 1)
       select b.term, b.c as column_ref, b.n as queries, round(b.n::double * (select count(*) from part) / (tc.n::double * cc.n), 4) as lift from b join tc on tc.term = b.term join cc on cc.c = b.c""",
)
def n04(v):
    return mining.mine_synonyms(v.sql_text, "question", "sql", columns=mining.measured_columns)


@query(
    "n04_mine_all_columns",
    """with x as (select p_partkey as q, lower(p_type) as kind, p_size % 3 as m from part),
       t as (select q, m, unnest(list_distinct(list_filter(regexp_split_to_array('count of ' || kind, '[^\\p{L}\\p{N}_]+'), lambda w: length(w) > 1))) as term from x),
       c as (select q, unnest(['user_' || m, 'region', 'day', 'k', 'amount']) as column_ref from x),
       b as (select term, column_ref, count(*) as n from t join c on t.q = c.q group by 1, 2 having count(*) >= 2),
       tc as (select term, count(*) as n from t group by 1), cc as (select column_ref, count(*) as n from c group by 1)
       select b.term, b.column_ref, b.n as queries, round(b.n::double * (select count(*) from part) / (tc.n::double * cc.n), 4) as lift
       from b join tc on tc.term = b.term join cc on cc.column_ref = b.column_ref""",
)
def n04_all(v):
    """Columns in COUNT(DISTINCT), SELECT, WHERE, ON and GROUP BY, with aliases."""
    asked = spread(v.part.select("p_type", "p_size")).select(
        F.concat(F.lit("Count of "), F.lower("p_type")).alias("question"),
        F.concat(
            F.lit("SELECT a.region, COUNT(DISTINCT a.User_"), (F.col("p_size") % 3).cast("string"),
            F.lit(") FROM main.sales a JOIN dim AS d ON a.k = d.k WHERE d.day >= '2024-01-01 note' AND amount > 5 GROUP BY region ORDER BY 2 DESC"),
        ).alias("sql"),
    )
    return mining.mine_synonyms(asked, "question", "sql")


@query(
    "n05_mine_joins",
    """select 't' || (p_size % 5) as left_table, 'd' || (p_size % 4) as right_table, 't' || (p_size % 5) || '.k=d' || (p_size % 4) || '.k' as condition, count(*) as queries from part group by 1, 2, 3""",
)
def n05(v):
    return mining.mine_joins(v.sql_text, "sql")


@query(
    "n05_mine_join_clauses",
    """with p as (select p_size % 5 as a, p_size % 4 as b from part)
       select 'main.orders' as left_table, 'customer' as right_table, 'o_custkey = c_custkey' as condition, count(*) as queries from p
       union all select 't' || a, 'd' || b, 'cast(t' || a || '.app_id as bigint) = d' || b || '.id', count(*) from p group by 1, 2, 3
       union all select 'd' || b, 'spans', 'd' || b || '.at >= spans.low and d' || b || '.at < (select max(caps.high) from caps q where caps.id in (1, 2))', count(*) from p group by 1, 2, 3
       union all select 'spans', 'days', 'cross', count(*) from p
       union all select 'x' || a, 'y', 'x' || a || '.id=y.id', count(*) from p group by 1, 2, 3
       union all select 'y', 'z' || b, 'cross', count(*) from p group by 1, 2, 3""",
)
def n05_clauses(v):
    """Joins on plain names, on wrapped names, on other comparisons, on nothing, and lists of tables."""
    a, b = ((F.col("p_size") % n).cast("string") for n in (5, 4))
    plain = F.lit("SELECT c_name, SUM(o_total) FROM main.orders JOIN customer ON o_custkey = c_custkey WHERE o_total > 5 GROUP BY c_name")
    wrapped = F.concat(
        F.lit("select * from t"), a, F.lit(" AS x left join d"), b, F.lit(" y ON CAST(x.app_id AS BIGINT) = y.id inner join spans s on y.at >= s.low"),
        F.lit("  and y.at < (select max(q.high) from caps q where q.id in (1, 2)) cross join days where s.note = 'a.b = c.d' order by 1"),
    )
    listed = F.concat(F.lit("SELECT 1 FROM x"), a, F.lit(" p, y AS q, z"), b, F.lit(" WHERE p.id = q.id AND q.n > 3"))
    return mining.mine_joins(spread(v.part.select("p_size")).select(F.explode(F.array(plain, wrapped, listed)).alias("sql")), "sql")


@query(
    "n05_mine_join_chains",
    """with p as (select p_size % 5 as a, p_size % 4 as b from part)
       select 'main.t' || a as left_table, 'd' || b as right_table, 'main.t' || a || '.j=d' || b || '.j and main.t' || a || '.k=d' || b || '.k' as condition, count(*) as queries from p group by 1, 2, 3
       union all select 'd' || b, 'e', 'd' || b || '.y=e.y', count(*) from p group by 1, 2, 3
       union all select 'e', 'f', 'using(z,w)', count(*) from p group by 1, 2, 3""",
)
def n05_chains(v):
    """Chains of joins with aliases, composite and turned conditions and USING."""
    a, b = ((F.col("p_size") % n).cast("string") for n in (5, 4))
    sql = F.concat(
        F.lit("SELECT count(*) FROM main.T"), a, F.lit(" x JOIN d"), b,
        F.lit(" AS y ON x.k = y.k AND y.j = x.j LEFT JOIN e ON y.y = e.y JOIN f USING (z, w) WHERE x.note = 'a.b = c.d'"),
    )
    return mining.mine_joins(spread(v.part.select("p_size")).select(sql.alias("sql")), "sql")


@query(
    "n06_relationship_type",
    """with l as (select max(n) as n from (select o_custkey, count(*) as n from orders group by 1) x), r as (select max(n) as n from (select c_custkey, count(*) as n from customer group by 1) x)
       select l.n as left_rows, r.n as right_rows, case when l.n > 1 then 'MANY' else 'ONE' end || '_TO_' || case when r.n > 1 then 'MANY' else 'ONE' end as relationship from l, r""",
)
def n06(v):
    return mining.relationship_type(
        v.orders.select(F.col("o_custkey").alias("k")), v.customer.select(F.col("c_custkey").alias("k")), ["k"]
    )


@query(
    "n06_relationship_many",
    """with l as (select max(n) as n from (select l_partkey, count(*) as n from lineitem group by 1) x), r as (select max(n) as n from (select o_custkey, count(*) as n from orders group by 1) x)
       select l.n as left_rows, r.n as right_rows, case when l.n > 1 then 'MANY' else 'ONE' end || '_TO_' || case when r.n > 1 then 'MANY' else 'ONE' end as relationship from l, r""",
)
def n06_many(v):
    return mining.relationship_type(
        v.lineitem.select(F.col("l_partkey").alias("k")), v.orders.select(F.col("o_custkey").alias("k")), ["k"]
    )


@query(
    "n07_mine_tables",
    """select name as table_name, count(*) as queries from (select 't' || (p_size % 5) as name from part union all select 'd' || (p_size % 4) from part) t group by 1""",
)
def n07(v):
    return mining.mine_tables(v.sql_text, "sql")


@query(
    "n08_mine_snippets",
    """select kind, text, count(*) as queries from (select 'measure' as kind, 'SUM(x' || (p_size % 3) || ')' as text from part
         union all select 'filter', 'size = ' || p_size from part union all select 'filter', 'kind = ''' || p_type || '''' from part) s group by 1, 2""",
)
def n08(v):
    return mining.mine_snippets(v.sql_text, "sql")


@query(
    "n09_ambiguous_synonyms",
    f"""with {DOCS}, listed as (select model_id, table_pos, column_name, synonym from ms union all select c_custkey, 1, 'name', lower(c_mktsegment) from customer)
        select model_id, synonym, count(distinct (table_pos, column_name)) as columns from listed group by 1, 2 having count(distinct (table_pos, column_name)) > 1""",
)
def n09(v):
    listed = model.explode_model(documents(v))["synonyms"].select("model_id", "table_pos", "column_name", "synonym")
    more = v.customer.select(
        F.col("c_custkey").alias("model_id"), F.lit(1).alias("table_pos"), F.lit("name").alias("column_name"),
        F.upper("c_mktsegment").alias("synonym"),
    )
    return mining.ambiguous_synonyms(listed.unionByName(more))


@query(
    "n10_duplicate_examples",
    """select c_custkey as model_id, 'SELECT N, COUNT(O_ID) FROM ORDERS WHERE N = ? GROUP BY N' as shape, cast(2 as bigint) as examples,
         least(md5(c_custkey || 'e2'), md5(c_custkey || 'e3')) as first_id from customer""",
)
def n10(v):
    return mining.duplicate_examples(model.explode_model(documents(v))["examples"])
