"""The model's views over the star-schema tables: atoms, markdown, pages, sessions, activity, tasks, links.

Each view is one ``selectExpr`` over a Parquet scan, so filters and column pruning reach the files. ``SQL`` has
the same views as common table expressions for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..model import ATOM_TYPES, LINK_TYPES

_TYPES = ", ".join(f"'{t}'" for t in ATOM_TYPES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id as ingest_seq",
        "left(sha2(concat('projects/', source, '/memory/', doc_id, '.md:0'), 256), 16) as id",
        "left(trim(substring_index(text, '\n', 1)), 40) as title",
        "text as body",
        f"element_at(array({_TYPES}), cast(doc_id % 9 + 1 as int)) as atom_type",
        "case doc_id % 10 when 0 then 'global' when 1 then 'shared' else 'project' end as scope",
        "concat('projects/', source, '/memory/', doc_id, '.md') as source_path",
        "case doc_id % 9 when 1 then 'agent_def' when 2 then 'skill_def' when 3 then 'plan_file' else 'memory_file' end as source_type",
        "case when doc_id % 10 = 0 then null else source end as project",
        "left(sha2(text, 256), 16) as content_hash",
        "concat('2024-', lpad(doc_id % 12 + 1, 2, '0'), '-', lpad(doc_id % 28 + 1, 2, '0'), ' 00:00:00') as created_at",
    )


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note a conversation: a second-level heading a turn. Turns are gathered per conversation, which bounds the group."""
    turns = table(spark, sf_dir, "conversations").selectExpr("conv_id", "struct(turn, role, text) as t")
    return turns.groupBy("conv_id").agg({"t": "collect_list"}).selectExpr(
        "conv_id", "concat('notes/', conv_id, '.md') as source_path", "array_join(transform(sort_array(`collect_list(t)`), t -> concat('## ', t.role, '\n', t.text)), '\n') as body"
    )


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (page_id, tag): the targets of a page's anchors stand for its tags."""
    rows = table(spark, sf_dir, "pages").selectExpr("page_id", "url", "explode(array_distinct(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1))) as tag")
    return rows


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session a conversation; project by number, first user text as summary."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(*_session_aggregates()).selectExpr(
        "concat('s', conv_id) as session_id", "concat('p', conv_id % 7) as project", "message_count", "left(first_user, 200) as summary", "last_role",
        "case when conv_id % 5 = 0 then null else concat('2024-02-', lpad(conv_id % 28 + 1, 2, '0'), 'T00:00:00Z') end as last_active",
        "concat('2024-01-', lpad(conv_id % 28 + 1, 2, '0'), 'T00:00:00Z') as started_at",
        "case conv_id % 5 when 0 then 'active' when 1 then 'waiting_input' when 2 then 'processing' when 3 then 'idle' else 'dead' end as status",
        "case conv_id % 4 when 0 then '' when 1 then null else concat('Title ', conv_id) end as title",
        "case when conv_id % 6 = 0 then concat('Custom ', conv_id) end as custom_title", "conv_id",
    )


def _session_aggregates():
    from pyspark.sql import functions as F

    return [F.count("*").alias("message_count"), F.expr("min_by(text, turn) filter (where role = 'user')").alias("first_user"), F.expr("max_by(role, turn)").alias("last_role")]


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task an order: blocked by the customer's order before it, and some by a task that is not there."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as id", "concat('c', o_custkey % 100) as project", "case o_orderstatus when 'F' then 'done' when 'P' then 'in_progress' else 'ready' end as status",
        "case when o_orderkey % 13 = 0 then null else cast(left(o_orderpriority, 1) as bigint) end as priority", "o_custkey", "date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') as created_at",
        "lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as before",
    ).selectExpr("id", "project", "status", "priority", "created_at", "filter(array(before, case when id % 17 = 0 then -id end), x -> x is not null) as blocked_by")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ", ".join(f"'{t}'" for t in LINK_TYPES[:3])
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as source_id", "l_partkey as target_id", f"element_at(array({kinds}), case l_returnflag when 'A' then 1 when 'N' then 2 else 3 end) as link_type", "l_discount as confidence", "l_linenumber as prio", "l_suppkey as tie"
    )


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id", "user_id", "ts", "event_type", "value", "props")


_SQL_TYPES = f"[{_TYPES}]"
SQL = {
    "v_atoms": f"""SELECT doc_id AS ingest_seq,
  left(sha256('projects/' || source || '/memory/' || doc_id || '.md:0'), 16) AS id,
  left(trim(split_part(text, chr(10), 1)), 40) AS title,
  text AS body,
  list_extract({_SQL_TYPES}, CAST(doc_id % 9 + 1 AS BIGINT)) AS atom_type,
  CASE doc_id % 10 WHEN 0 THEN 'global' WHEN 1 THEN 'shared' ELSE 'project' END AS scope,
  'projects/' || source || '/memory/' || doc_id || '.md' AS source_path,
  CASE doc_id % 9 WHEN 1 THEN 'agent_def' WHEN 2 THEN 'skill_def' WHEN 3 THEN 'plan_file' ELSE 'memory_file' END AS source_type,
  CASE WHEN doc_id % 10 = 0 THEN NULL ELSE source END AS project,
  left(sha256(text), 16) AS content_hash,
  '2024-' || lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') || '-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') || ' 00:00:00' AS created_at
FROM documents""",
    "v_markdown": """SELECT conv_id, 'notes/' || conv_id || '.md' AS source_path,
  string_agg('## ' || role || chr(10) || text, chr(10) ORDER BY turn, role, text) AS body FROM conversations GROUP BY conv_id""",
    "v_page_links": """SELECT page_id, url, unnest(list_distinct(regexp_extract_all(html, '<a href="([^"]*)"', 1))) AS tag FROM pages""",
    "v_sessions": """SELECT 's' || conv_id AS session_id, 'p' || (conv_id % 7) AS project, count(*) AS message_count,
  left(min_by(text, turn) FILTER (WHERE role = 'user'), 200) AS summary, max_by(role, turn) AS last_role,
  CASE WHEN conv_id % 5 = 0 THEN NULL ELSE '2024-02-' || lpad(CAST(conv_id % 28 + 1 AS VARCHAR), 2, '0') || 'T00:00:00Z' END AS last_active,
  '2024-01-' || lpad(CAST(conv_id % 28 + 1 AS VARCHAR), 2, '0') || 'T00:00:00Z' AS started_at,
  CASE conv_id % 5 WHEN 0 THEN 'active' WHEN 1 THEN 'waiting_input' WHEN 2 THEN 'processing' WHEN 3 THEN 'idle' ELSE 'dead' END AS status,
  CASE conv_id % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'Title ' || conv_id END AS title,
  CASE WHEN conv_id % 6 = 0 THEN 'Custom ' || conv_id END AS custom_title, conv_id
FROM conversations GROUP BY conv_id""",
    "v_tasks": """SELECT id, project, status, priority, created_at, list_filter([before, CASE WHEN id % 17 = 0 THEN -id END], lambda x: x IS NOT NULL) AS blocked_by FROM (
  SELECT o_orderkey AS id, 'c' || (o_custkey % 100) AS project, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'in_progress' ELSE 'ready' END AS status,
    CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(left(o_orderpriority, 1) AS BIGINT) END AS priority, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS created_at,
    lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders)""",
    "v_links": """SELECT l_orderkey AS source_id, l_partkey AS target_id, CASE l_returnflag WHEN 'A' THEN 'references' WHEN 'N' THEN 'extends' ELSE 'refines' END AS link_type,
  l_discount AS confidence, l_linenumber AS prio, l_suppkey AS tie FROM lineitem""",
}


def with_views(sql: str, *views: str) -> str:
    """``sql`` under the common table expressions that it names."""
    return "WITH " + ",\n".join(f"{v} AS ({SQL[v]})" for v in views) + "\n" + sql
