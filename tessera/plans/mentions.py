"""Queries of gazetteers and shipped rules, as-of joins, contracts, merges and stored links."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import rules, shipped
from tessera.operators import asof, gazetteer, links, names, tables
from tessera.operators.retrieval import spread
from tessera.plans.catalog import CHUNKS, chunks, query
from tessera.sources import contracts, merge
from tessera.sources.rounds import settle
from tessera.sources.tables import read

#: What is asked after each turn of a conversation, so that every rule is met; the first ones are whole questions.
ASKED = (
    "你好！", "谢谢", "第十二条的内容", "《商业银行资本管理办法》第43条", "银发[2023]12号怎么说", "第三章的条款", "附件3在哪里", "表 12 里的数字", "拨备覆盖率的数值是多少",
    "杠杆率最低为5%吗", "一级资本的比例要求是多少", "核心一级资本充足率的标准", "什么是逆周期资本？", "请解释储备资本的含义", "大型商业银行和中型银行的区别", "哪个银行的要求更高",
    "是否符合2024年Q1的规定", "能不能超过300亿元", "有哪些主要内容", "介绍现行有效的规定", "风险加权资产是指已废止的计算", "今年国务院不得调整全部存贷比",
    "银保监会应当公布2023-05的修订草案", "LCR与流动性覆盖率", "CAR最低多少", "附表二和表3.1的说明内容", "所有银行可以在2025年3月执行吗",
)
WHOLE = 2
QUESTIONS = (
    f"asked AS (SELECT conv_id, turn, role, CASE WHEN (conv_id * 31 + turn) % {len(ASKED)} < {WHOLE} THEN a ELSE text || ' ' || a END AS text FROM "
    f"(SELECT *, [{', '.join(f"'{a}'" for a in ASKED)}][(conv_id * 31 + turn) % {len(ASKED)} + 1] AS a FROM conversations))"
)


def questions(spark, sf):
    at = F.pmod(F.col("conv_id") * 31 + F.col("turn"), F.lit(len(ASKED)))
    asked = F.get(F.array(*map(F.lit, ASKED)), at.cast("int"))
    return read(spark, sf, "conversations").select("conv_id", "turn", "role", F.when(at < WHOLE, asked).otherwise(F.concat("text", F.lit(" "), asked)).alias("text"))


def _hit(i: int, name: str, rx: str, sure: float) -> str:
    return f"CASE WHEN regexp_matches(trim(text), '(?i){rx}') THEN {{'d': {-sure}, 'n': {i}, 'i': '{name}', 'r': '{rx}'}} END"


@query(
    f"WITH {QUESTIONS}, h AS (SELECT conv_id, turn, role, list_sort([x FOR x IN [{', '.join(_hit(i, *r) for i, r in enumerate(shipped.INTENTS))}] IF x IS NOT NULL]) AS h FROM asked) "
    "SELECT conv_id, turn, role, coalesce(h[1].i, 'unknown') AS intent, coalesce(round(-CAST(h[1].d AS DOUBLE) * CASE WHEN len(list_distinct([x.i FOR x IN h])) > 1 THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END, 4), 0.3)::DOUBLE AS confidence, "
    "coalesce(array_to_string([x.r FOR x IN h IF x.i = h[1].i], ' & '), '') AS matched FROM h"
)
def qu1_shipped(spark, sf):
    """The intent of each question by the 19 shipped rules."""
    found = rules.intent_of(F.col("text"))
    return questions(spark, sf).select("conv_id", "turn", "role", found["intent"].alias("intent"), found["confidence"].alias("confidence"), F.array_join(found["rules"], " & ").alias("matched"))


def _values(kind: str, rx: str, group: int, sure: float) -> str:
    return f"SELECT conv_id, turn, role, '{kind}' AS kind, trim(unnest(regexp_extract_all(trim(text), '{rx}', {group}))) AS value, {sure}::DOUBLE AS confidence FROM asked"


@query(
    f"WITH {QUESTIONS}, e AS ({' UNION ALL '.join(_values(*p) for p in (*shipped.PATTERNS, *(('term', rx, 1, sure) for rx, sure in shipped.TERMS)))} UNION ALL "
    f"SELECT conv_id, turn, role, kind, name, confidence FROM asked, (VALUES {', '.join(f"('{k}', '{n}', {c}::DOUBLE)" for k, c, names in shipped.GAZETTEERS for n in names)}) g(kind, name, confidence) WHERE contains(text, name)) "
    "SELECT conv_id, turn, role, kind, value, max(confidence) AS confidence FROM e WHERE value <> '' AND (kind <> 'term' OR length(value) <= 30) GROUP BY ALL"
)
def qu2_shipped(spark, sf):
    """Entities of each question by the shipped patterns, gazetteers and terms."""
    return gazetteer.entities(questions(spark, sf), ["conv_id", "turn", "role"], "text")


def _first(words: tuple[tuple[str, str], ...]) -> str:
    return "CASE " + " ".join(f"WHEN contains(text, '{w}') THEN '{v}'" for w, v in words) + " END"


@query(
    f"WITH {QUESTIONS} SELECT conv_id, turn, role, CASE {' '.join(f"WHEN regexp_matches(text, '{t}') THEN regexp_extract(text, '{t}', 1)" for t in shipped.TIMES)} END AS time_range, "
    f"array_to_string([s FOR s IN ['active', 'repealed', 'expired', 'superseded', 'draft'] IF {' OR '.join(f"(s = '{v}' AND contains(text, '{w}'))" for w, v in shipped.STATES)}], ',') AS version_status, "
    f"{_first(shipped.SCOPES)} AS applicable_scope, {_first(shipped.NORMS)} AS normative_level FROM asked"
)
def qu3_shipped(spark, sf):
    """Constraints of each question by the shipped words."""
    found = rules.constraints_of(F.col("text"))
    return questions(spark, sf).select(
        "conv_id", "turn", "role", found["time_range"].alias("time_range"), F.array_join(found["version_status"], ",").alias("version_status"),
        found["applicable_scope"].alias("applicable_scope"), found["normative_level"].alias("normative_level"),
    )


@query("""WITH g AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{4,}')) AS name FROM benchmark), f AS (SELECT doc_id, name, instr(text, name) - 1 AS first FROM documents, g WHERE contains(text, name))
 SELECT doc_id, name, CAST(first AS INTEGER) AS first, NOT EXISTS (SELECT 1 FROM f o WHERE o.doc_id = f.doc_id AND o.name <> f.name AND contains(o.name, f.name)) AS longest FROM f""")
def qu2_gazetteer(spark, sf):
    """Every word of four letters or more of the benchmark, wherever it stands in a document, and whether no longer one found there holds it."""
    known = read(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0))).alias("name"))
    found = settle(gazetteer.occurrences(read(spark, sf, "documents"), ["doc_id"], "text", known))  # read three times
    kept = gazetteer.longest(found, ["doc_id"], known).select("doc_id", "name", F.lit(True).alias("longest"))
    return found.join(kept, ["doc_id", "name"], "left").select("doc_id", "name", "first", F.coalesce("longest", F.lit(False)).alias("longest"))


#: Groups of names for part types: (group_id, nth, name).
GROUPS = ((0, 0, "BRUSHED"), (0, 1, "MATTE"), (1, 0, "BRUSHED STEEL"), (1, 1, "IRON"), (2, 0, "PROMO"), (2, 1, "OFFER"), (2, 2, "SALE"), (3, 0, "STEEL"), (3, 1, "ALLOY"))


@query(f"""WITH g(group_id, nth, name) AS (VALUES {', '.join(map(str, GROUPS))}), f AS (SELECT p_partkey, p_type, g.group_id, g.name, instr(p_type, g.name) AS at FROM part, g WHERE contains(p_type, g.name)),
 k AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM f o WHERE o.p_partkey = f.p_partkey AND o.name <> f.name AND contains(o.name, f.name))),
 a AS (SELECT p_partkey, g.name, min(struct_pack(at := k.at, nth := g.nth)) AS place FROM k JOIN g USING (group_id) WHERE g.name <> k.name AND NOT contains(k.p_type, g.name) GROUP BY ALL)
 SELECT p_partkey, p_type || coalesce(' ' || (SELECT string_agg(name, ' ' ORDER BY place, name) FROM a WHERE a.p_partkey = part.p_partkey), '') AS expanded FROM part""")
def qu6_in_order(spark, sf):
    """Part types followed by the other names of what they mention, in the order of mention, by the automaton."""
    groups = spark.createDataFrame(GROUPS, "group_id int, nth int, name string")
    return gazetteer.expand(read(spark, sf, "part"), ["p_partkey"], "p_type", groups)


@query("""WITH t AS (SELECT DISTINCT p_type AS name FROM part), a AS (SELECT p_partkey AS ask_id, CASE p_partkey % 3 WHEN 0 THEN p_type WHEN 1 THEN lower(p_type) ELSE trim(left(p_type, CAST(ceil(length(p_type) * 0.7) AS BIGINT))) END AS text FROM part),
 m AS (SELECT ask_id, name, CASE WHEN text = name THEN 1 WHEN lower(text) = lower(name) THEN 2 ELSE 3 END AS level,
  CASE WHEN lower(text) = lower(name) THEN 1.0::DOUBLE ELSE least(length(text), length(name))::DOUBLE / greatest(length(text), length(name)) END AS score FROM a, t WHERE contains(lower(name), lower(text)) OR contains(lower(text), lower(name)))
 SELECT ask_id, name, level, round(score, 6) AS score FROM m QUALIFY row_number() OVER (PARTITION BY ask_id ORDER BY level, score DESC, name) = 1""")
def jn13_types(spark, sf):
    """Part types told whole, in other case, or by most of their beginning, among all part types."""
    part = read(spark, sf, "part")
    begun = F.trim(F.left("p_type", F.ceil(F.length("p_type") * 0.7).cast("int")))
    text = F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).when(F.col("p_partkey") % 3 == 1, F.lower("p_type")).otherwise(begun)
    return names.resolve_tables(part.select(F.col("p_partkey").alias("ask_id"), text.alias("text")), part.select(F.col("p_type").alias("name")))


@query("""WITH v AS (SELECT user_id, ts, max(event_id) AS version_id FROM events WHERE event_type = 'signup' GROUP BY ALL), u AS (SELECT v.*, v.ts + to_hours(CAST(floor(e.value) AS BIGINT)) AS until FROM v JOIN events e ON e.event_id = v.version_id)
 SELECT e.event_id, u.version_id, CASE WHEN u.version_id IS NULL THEN 'not_yet_effective' WHEN e.ts >= u.until THEN 'superseded' ELSE 'active' END AS state
 FROM (SELECT * FROM events WHERE event_type <> 'signup') e ASOF LEFT JOIN u ON e.user_id = u.user_id AND e.ts >= u.ts""")
def jn16_versions(spark, sf):
    """Each event by the signup of its user that was in force: the last before it, unless its value in hours has passed."""
    e = read(spark, sf, "events")
    v = e.filter("event_type = 'signup'").select("user_id", F.col("ts").alias("since"), F.col("event_id").alias("version_id"), (F.col("ts") + F.expr("make_dt_interval(0, CAST(floor(value) AS INT))")).alias("until"))
    asks = e.filter("event_type <> 'signup'").select("event_id", "user_id", "ts")
    found = asof.as_of(asks, v, ["user_id"], "ts", "since", "until", tie="version_id")
    return found.select("event_id", F.col("version.version_id").alias("version_id"), "state")


@query("""WITH t AS (SELECT o_orderkey, ['active', 'In_Force', 'superseded', '废止', 'draft', ''][o_orderkey % 6 + 1] AS status, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS begun, o_orderdate AS d,
 CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 400 DAY END AS until FROM orders)
 SELECT o_orderkey, CASE WHEN until <= DATE '1997-01-01' THEN 'superseded_before_query' WHEN d >= DATE '1997-01-02' THEN 'not_yet_effective' WHEN status = '废止' THEN 'repealed' WHEN status = 'superseded' THEN 'superseded' WHEN status = 'draft' THEN 'unknown_status' END AS issue,
 CASE WHEN until <= DATE '1997-01-01' OR d >= DATE '1997-01-02' OR status = '废止' THEN 'error' WHEN status IN ('superseded', 'draft') THEN 'warning' ELSE 'ok' END AS verdict FROM t""")
def ver2_states(spark, sf):
    """Orders as versions told in words: states, dates in several forms, and dates that only the content has."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    status = F.element_at(F.array(*map(F.lit, ("active", "In_Force", "superseded", "废止", "draft", ""))), (key % 6 + 1).cast("int"))
    begun = F.when(key % 4 != 0, F.date_format(day, "yyyy年M月d日"))
    until = F.when(key % 3 == 0, F.date_format(day + F.expr("INTERVAL 400 DAYS"), "yyyy.M.d"))
    content = F.concat(F.lit("自"), F.date_format(day, "yyyy/M/d"), F.lit("起施行, 2099-01-01"))
    found = asof.version_issue(status, begun, until, content, F.lit("1997年1月1日"))
    return read(spark, sf, "orders").select("o_orderkey", found["issue"].alias("issue"), found["verdict"].alias("verdict"))


#: What an event's text must be.
EVENT = {
    "type": "object", "required": ["event_id", "event_type", "user"], "additionalProperties": False,
    "properties": {
        "event_id": {"type": "string"}, "event_type": {"type": "string", "enum": ["view", "click", "purchase", "signup"]}, "value": {"type": ["integer", "null"], "minimum": 0, "maximum": 100},
        "user": {"type": "object", "required": ["id"], "properties": {"id": {"type": "integer"}, "tags": {"type": "array", "items": {"type": "string"}}}},
    },
}


@query("""WITH e AS (SELECT event_id % 8 AS m, event_type, CAST(floor(value) AS BIGINT) AS v FROM events)
 SELECT '$.event_type' AS path, 'required' AS rule, count(*) AS n FROM e WHERE m = 1 UNION ALL SELECT '$.event_id', 'type', count(*) FROM e WHERE m = 2 UNION ALL SELECT '$.user.id', 'required', count(*) FROM e WHERE m = 3
 UNION ALL SELECT '$.user.tags[*]', 'type', count(*) FROM e WHERE m = 3 UNION ALL SELECT '$.value', 'minimum', count(*) FROM e WHERE m = 4 UNION ALL SELECT '$.value', 'maximum', count(*) FROM e WHERE v > 100 AND m NOT IN (4, 6)
 UNION ALL SELECT '$.x', 'additionalProperties', count(*) FROM e WHERE m = 5 UNION ALL SELECT '$', 'json', count(*) FROM e WHERE m = 6 UNION ALL SELECT '$.user', 'type', count(*) FROM e WHERE m = 7
 UNION ALL SELECT '$.event_type', 'enum', count(*) FROM e WHERE event_type = 'error' AND m NOT IN (1, 6)""")
def snk6_contract(spark, sf):
    """Events as JSON texts with a fault each, by the schema's rules."""
    m, s = F.col("event_id") % 8, lambda c: F.col(c).cast("string")
    kind = F.when(m == 1, "").otherwise(F.concat(F.lit('"event_type": "'), "event_type", F.lit('", ')))
    name = F.when(m == 2, s("event_id")).otherwise(F.concat(F.lit('"'), s("event_id"), F.lit('"')))
    user = F.when(m == 3, '{"tags": ["t", 1]}').when(m == 7, "null").otherwise(F.concat(F.lit('{"id": '), s("user_id"), F.lit(', "tags": ["t"]}')))
    value = F.when(m == 4, "-1").otherwise(F.floor("value").cast("long").cast("string"))
    end = F.when(m == 5, ', "x": 1}').when(m == 6, "").otherwise("}")
    text = F.concat(F.lit('{"event_id": '), name, F.lit(", "), kind, F.lit('"user": '), user, F.lit(', "value": '), value, end)
    return contracts.summary(spread(read(spark, sf, "events")).select(text.alias("text")), "text", EVENT)


@query("""WITH o AS (SELECT c_custkey AS k, c_custkey + 1000 AS id, '2020' AS created, c_name AS name, c_mktsegment AS segment FROM customer WHERE c_custkey % 2 = 0),
 n AS (SELECT c_custkey AS k, '2024' AS created, upper(c_name) AS name, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE lower(c_mktsegment) END AS segment FROM customer WHERE c_custkey % 3 = 0)
 SELECT k, id, created, coalesce(n.name, o.name) AS name, CASE WHEN n.segment <> '' THEN n.segment ELSE o.segment END AS segment FROM (SELECT k, id, created, name, segment FROM o) o LEFT JOIN (SELECT k, name, segment FROM n) n USING (k) UNION ALL
 SELECT k, (SELECT max(id) FROM o) + row_number() OVER (ORDER BY k), created, name, segment FROM n WHERE k NOT IN (SELECT k FROM o)""")
def src7_merge(spark, sf):
    """Customers merged with later rows: ids and creation times of those that are there stay, empty segments keep the old one, new rows are numbered on."""
    c = read(spark, sf, "customer")
    old = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") + 1000).alias("id"), F.lit("2020").alias("created"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    new = c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.lit("2024").alias("created"), F.upper("c_name").alias("name"), F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.lower("c_mktsegment")).alias("segment"))
    return merge.merge(old, new, "k", rules={"created": "old", "segment": "filled"}, number="id")


@query(f"""WITH {CHUNKS}, g AS (SELECT doc_id FROM labels WHERE quality = 0) SELECT 'document' AS kind, doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM g)
 UNION ALL SELECT 'chunk', chunk_id FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM g)""")
def src10_both(spark, sf):
    """Documents and their chunks without those that tombstones name."""
    left = merge.without({"document": read(spark, sf, "documents"), "chunk": chunks(spark, sf)}, read(spark, sf, "labels").filter("quality = 0"), "doc_id")
    ids = [left[kind].select(F.lit(kind).alias("kind"), F.col(c).alias("id")) for kind, c in (("document", "doc_id"), ("chunk", "chunk_id"))]
    return ids[0].unionByName(ids[1])


LINKED = f"""{CHUNKS}, l AS (SELECT *, lag(chunk_id) OVER w AS prev_id, lead(chunk_id) OVER w AS next_id, CASE WHEN pos % 4 <> 0 THEN doc_id * 4294967296 + pos - pos % 4 END AS up FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
 k AS (SELECT l.*, p.chunk_id AS parent_id FROM l LEFT JOIN chunks p ON p.chunk_id = l.up)"""


def linked(spark, sf):
    """Chunks with stored links: every fourth line of a document is the parent of those up to the next; a blank one leaves roots."""
    c = links.auto_link(chunks(spark, sf)).withColumn("up", F.when(F.col("pos") % 4 != 0, F.col("chunk_id") - F.col("pos") % 4))
    known = c.select(F.col("chunk_id").alias("parent_id"))
    return c.join(known, c["up"] == known["parent_id"], "left")


@query(f"""WITH {LINKED} SELECT chunk_id, 0 AS distance, chunk_id AS near_id FROM k UNION ALL SELECT chunk_id, -1, prev_id FROM k WHERE prev_id IS NOT NULL UNION ALL SELECT chunk_id, 1, next_id FROM k WHERE next_id IS NOT NULL
 UNION ALL SELECT k.chunk_id, -2, p.prev_id FROM k JOIN k p ON p.chunk_id = k.prev_id WHERE p.prev_id IS NOT NULL UNION ALL SELECT k.chunk_id, 2, p.next_id FROM k JOIN k p ON p.chunk_id = k.next_id WHERE p.next_id IS NOT NULL""")
def jn6_walk(spark, sf):
    """The neighbours of every chunk along its stored links, two steps to each side."""
    c = settle(linked(spark, sf).select("chunk_id", "prev_id", "next_id"))  # read a dozen times
    return links.walk(c, c)


@query(f"""WITH {LINKED}, s AS (SELECT doc_id, parent_id, list(chunk_id ORDER BY chunk_id) AS kin FROM k GROUP BY ALL)
 SELECT k.chunk_id, md5(k.content) AS chunk, md5(p.content) AS parent, md5(a.content) AS prev, md5(b.content) AS next, coalesce(array_to_string(c.kin, ','), '') AS children, array_to_string(s.kin, ',') AS siblings
 FROM k LEFT JOIN k p ON p.chunk_id = k.parent_id LEFT JOIN k a ON a.chunk_id = k.prev_id LEFT JOIN k b ON b.chunk_id = k.next_id LEFT JOIN s c ON c.parent_id = k.chunk_id
 LEFT JOIN s ON s.doc_id = k.doc_id AND s.parent_id IS NOT DISTINCT FROM k.parent_id""")
def jn7_bundles(spark, sf):
    """Every chunk with its parent, neighbours, children and siblings by the stored links; a root's siblings are its document's roots."""
    c = settle(linked(spark, sf).select("chunk_id", "doc_id", "parent_id", "prev_id", "next_id", F.md5("content").alias("content")))  # read six times
    return links.bundles(c, c).select("chunk_id", "chunk", "parent", "prev", "next", F.array_join("children", ",").alias("children"), F.array_join("siblings", ",").alias("siblings"))


@query("""SELECT p_brand AS table_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS row_index, p_name AS name, CASE WHEN p_partkey % 10 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END AS size, CAST(p_partkey AS VARCHAR) AS key FROM part""")
def tab1_parts(spark, sf):
    """Each brand's parts as Markdown tables of chunks of 200 keys under one header, all but the first one's own being dropped; some rows lack their last cell."""
    part = read(spark, sf, "part")
    piece = F.floor(F.col("p_partkey") / 200)
    row = F.concat(F.lit("| "), F.col("p_partkey").cast("string"), F.lit(" | "), "p_name", F.when(F.col("p_partkey") % 10 == 0, " |").otherwise(F.concat(F.lit(" | "), F.col("p_size").cast("string"), F.lit(" |"))))
    text = part.groupBy(F.col("p_brand").alias("table_id"), piece.alias("chunk_id")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", row.alias("row")))).alias("rows"))
    text = text.withColumn("content", F.concat(F.lit("Parts\n| key | name | size |\n|---|:-:|---|\n"), F.array_join("rows.row", "\n")))
    parsed = tables.parse(text)
    return parsed.select("table_id", F.col("row_index").cast("long").alias("row_index"), F.get("cells", 1).alias("name"), F.get("cells", 2).alias("size"), F.get("cells", 0).alias("key"))
