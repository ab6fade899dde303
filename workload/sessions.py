"""Conversation sessions and question text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.functions import text
from tallyward.operators import usage
from workload.inputs import QUESTIONS, oracle, table, view


def _last_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = usage.last_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    return recent.select("conv_id", "turn", "role", "back")


def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    user = F.col("role") == "user"
    line = usage.turn_line(
        F.col("text"), F.lit("stats_tool"), F.when(user, F.lit("describe")), F.when(~user, F.lit("region")), F.when(F.col("turn") == 1, F.lit("{}"))
    )
    return usage.session_context(turns, "conv_id", "turn", line)


def _normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.normalize_question(F.col("text")).alias("question"))


def _key(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = view(spark, sf_dir, QUESTIONS)
    filters = F.when(
        F.col("expected") != "no_match",
        F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("expected"), F.col("expected")),
    )
    key = text.question_key(F.concat(F.lit("tenant-"), "user_id"), F.lit("events"), F.col("question"), filters)
    return questions.select("question_id", key.alias("key"))


# Leading and trailing blanks, runs of blanks and closing marks; the test texts hold ASCII blanks only.
NORMALIZED = "trim(regexp_replace(trim(regexp_replace(lower({c}), '\\s+', ' ', 'g')), '[?!.,]+$', ''))"

QUERIES = {"last_turns": _last_turns, "session_context": _context, "normalize_text": _normalize, "question_key": _key}

ORACLES = {
    "last_turns": """SELECT * FROM (SELECT conv_id, turn, role,
        CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS INTEGER) AS back FROM conversations) WHERE back <= 5""",
    "session_context": """SELECT conv_id, string_agg('Previous question: ''' || text || '''' ||
        CASE WHEN role = 'user' THEN ' -> used stats_tool on ''describe''' ELSE ' grouped by ''region''' END ||
        CASE WHEN turn = 1 THEN ' with filters {}' ELSE '' END, chr(10) ORDER BY turn) AS context
        FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 5 GROUP BY 1""",
    "normalize_text": f"SELECT conv_id, turn, {NORMALIZED.format(c='text')} AS question FROM conversations",
    "question_key": oracle(
        f"""SELECT question_id, sha256('tenant-' || user_id || '|events|' || {NORMALIZED.format(c='question')} || '|' ||
            CASE WHEN expected <> 'no_match' THEN '{{"expected": "' || expected || '", "user": "' || user_id || '"}}' ELSE '{{}}' END) AS key FROM q""",
        q=QUESTIONS,
    ),
}
