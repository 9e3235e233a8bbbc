"""SQL fragments shared by the SQL twins: the stand-in tables as common table expressions."""

from __future__ import annotations

from ticketloom import vocab


def case(expr: str, entries: dict, default: str | None = None) -> str:
    """A CASE over constants."""
    def lit(v):
        return str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"

    arms = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in entries.items())
    tail = f" ELSE {default}" if default else ""
    return f"CASE {expr} {arms}{tail} END"


PRIORITY_OF_ORDER = case("left(o_orderpriority, 1)", {"1": "P1", "2": "P2", "3": "P3", "4": "P4", "5": "P4"}, "'P3'")
STATUS_OF_ORDER = case("o_orderstatus", {"O": "open", "P": "pending", "F": "resolved"})
SLA_HOURS = case("priority", vocab.SLA_HOURS, str(vocab.DEFAULT_SLA_HOURS))

TICKETS = f"""tickets AS (
  SELECT o_orderkey AS ticket_id, o_custkey AS customer_id, c_mktsegment AS category,
         o_orderpriority AS raw_priority, {PRIORITY_OF_ORDER} AS priority, {STATUS_OF_ORDER} AS status,
         o_orderdate AS created_at
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

RESOLVED = f"""{TICKETS},
resolved AS (
  SELECT t.*, r.resolved_at, date_diff('microsecond', t.created_at, r.resolved_at) / 3600000000.0 AS resolution_hours
  FROM tickets t LEFT JOIN (
    SELECT o_orderkey, min(l_shipdate) AS resolved_at
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate >= o_orderdate
    GROUP BY o_orderkey) r ON r.o_orderkey = t.ticket_id)"""

ARTICLES = """articles AS (
  SELECT doc_id AS article_id, split_part(text, chr(10), 1) AS title, text AS content, source AS category, lang,
         CASE WHEN lang = 'es' THEN 'archived' ELSE 'published' END AS status
  FROM documents)"""

TEXT_TICKETS = """text_tickets AS (
  SELECT d.doc_id AS ticket_id, split_part(text, chr(10), 1) AS subject,
         CASE WHEN instr(text, chr(10)) = 0 THEN '' ELSE substr(text, instr(text, chr(10)) + 1) END AS body,
         source AS category, lang,
         CASE WHEN quality = 0 THEN 'open' WHEN quality = 1 THEN 'resolved' ELSE 'closed' END AS status
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""

LOGS = """logs AS (
  SELECT event_id AS log_id, event_type AS endpoint, value AS latency_ms, props AS response_body,
         user_id AS session_user, ts AS created_at FROM events)"""

FEEDBACK = """feedback AS (
  SELECT event_id AS feedback_id, user_id AS draft_id,
         CAST(least(4.0, floor(value / 20)) + 1 AS INTEGER) AS rating, ts AS created_at
  FROM events WHERE event_type = 'purchase')"""

DRAFTS = """drafts AS (
  SELECT conv_id AS ticket_id, turn AS draft_no, text AS draft_text FROM conversations WHERE role = 'assistant')"""


def tokens(expr: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({expr}), '[^\\p{{L}}\\p{{N}}_]+'), lambda t: t <> '')"
