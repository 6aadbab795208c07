"""Chat sessions: intent, context under a budget, session tables, routing of replies.

turns: session_id, turn_number, user_query, answer, tokens, ts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.operators.retrieval import ranked

# Fixed values.
LIBRARY_PHRASES = (
    "doc library", "document library", "what documents", "which documents", "list all documents", "list documents", "list all docs", "list docs",
    "what files", "which files", "list all files", "list files", "summarise all", "summarize all", "summary of all", "summarise the doc",
    "summarize the doc", "summarise the lib", "summarize the lib", "all the docs", "all the documents", "all the files", "all docs", "all documents",
    "what do you have", "what have you got", "what's in the library", "what is in the library", "how many documents", "how many docs", "how many files",
    "library overview", "library summary", "what's available", "what is available", "show me all", "show all docs", "show all documents",
)
TOPICS = (" about ", " regarding ", " related to ", " on the topic of ", " concerning ")
CONNECTORS = (" and ", " also ", " plus ", " as well as ")
MARKER = "[[FILE_LIST]]"
BUDGET, RECENT, ANSWER_CUT = 1500, 5, 150


def intent(query: Column) -> Column:
    """struct(intent, confidence) by key phrases."""
    low = F.lower(query)
    holds = lambda phrases: F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(low, p))
    made = lambda name, c: F.struct(F.lit(name).alias("intent"), F.lit(c).alias("confidence"))
    return F.when(~holds(LIBRARY_PHRASES), made("rag", 1.0)).when(holds(TOPICS + CONNECTORS), made("compound", 0.9)).otherwise(made("library", 0.95))


def conversation_context(turns: DataFrame, sessions: DataFrame, budget: int = BUDGET, counter=X.word_count) -> DataFrame:
    """(session_id, context, tokens): the summary if it fits, then facts (as many as fit), then the last turns, newest first, until one doesn't fit.

    sessions: session_id, summary, key_facts (array of text)."""
    head = sessions.select("session_id", F.lit(0).alias("kind"), F.lit(0).alias("place"), F.concat(F.lit("Summary: "), "summary").alias("part")).where("part IS NOT NULL")
    facts = sessions.select("session_id", F.lit(1).alias("kind"), F.posexplode("key_facts").alias("place", "fact")).select("session_id", "kind", "place", F.concat(F.lit("- "), "fact").alias("part"))
    last = ranked(turns, ["session_id"], F.desc("turn_number"), name="place").where(F.col("place") < RECENT)
    recent = last.select("session_id", F.lit(2).alias("kind"), "place", F.concat(F.lit("User: "), "user_query", F.lit("\nAssistant: "), F.substring("answer", 1, ANSWER_CUT)).alias("part"))
    parts = head.unionByName(facts).unionByName(recent).withColumn("cost", counter(F.col("part")))
    # a part is in if all before it of its kind are in, and it fits what earlier kinds leave
    for kind in (0, 1, 2):
        spent = F.coalesce(F.sum(F.when(F.col("kind") < kind, F.col("used"))).over(Window.partitionBy("session_id")), F.lit(0)) if kind else F.lit(0)
        run = F.sum("cost").over(Window.partitionBy("session_id", "kind").orderBy("place"))
        mine = F.when(spent + run <= budget, F.col("cost"))
        parts = parts.withColumn("used", F.when(F.col("kind") == kind, mine).otherwise(F.col("used") if kind else F.lit(None).cast("int")))
    kept = parts.where("used IS NOT NULL")
    rows = F.array_sort(F.collect_list(F.struct("kind", "place", "part")))
    return kept.groupBy("session_id").agg(F.array_join(F.transform(rows, lambda x: x["part"]), "\n").alias("context"), F.sum("used").alias("tokens"))


def recent_turns(turns: DataFrame, n: int = RECENT, cut: int = 500) -> DataFrame:
    """The last n turns of each session, oldest first, answers cut."""
    last = ranked(turns, ["session_id"], F.desc("turn_number"), name="_n").where(F.col("_n") < n)
    return ranked(last.withColumn("answer", F.substring("answer", 1, cut)), ["session_id"], F.col("turn_number"), name="place").drop("_n")


def session_summaries(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """Turns and tokens (null: 0) of each session, and its place by last change."""
    g = turns.groupBy("session_id").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens"), F.max("ts").alias("changed"))
    return sessions.join(g, "session_id", "left").select("session_id", F.coalesce("turns", F.lit(0)).alias("turns"), F.coalesce("tokens", F.lit(0)).alias("tokens"), "changed")


def compact(turns: DataFrame, keep: int = 2) -> DataFrame:
    return ranked(turns, ["session_id"], F.desc("turn_number"), name="_n").where(F.col("_n") < keep).drop("_n")


def clear(turns: DataFrame, sessions: DataFrame) -> DataFrame:
    return turns.join(sessions.select("session_id"), "session_id", "left_anti")


def scoped(resolved: Column, scope: Column) -> Column:
    """resolved within scope, in its order; a null of either doesn't restrict."""
    return F.when(scope.isNull(), resolved).when(resolved.isNull(), scope).otherwise(F.filter(resolved, lambda x: F.array_contains(scope, x)))


def routing(reply: Column, question: Column) -> Column:
    """struct(mode, query) of a pre-pass reply; retrieval of the question where it says nothing."""
    j = X.parsed(reply, "mode string, rewritten_query string")
    mode = F.when(j["mode"].isin("library", "compound", "retrieval"), j["mode"]).otherwise("retrieval")
    return F.struct(mode.alias("mode"), F.coalesce(F.nullif(X.trimmed(j["rewritten_query"]), F.lit("")), question).alias("query"))


def updated_memory(summary: Column, facts: Column, reply: Column, turn: Column) -> Column:
    """struct(summary, facts) after a reply: replaced, or kept where it can't be parsed; facts need text and source and get the turn."""
    j = X.parsed(reply, "summary string, key_facts array<struct<fact:string,source:string>>")
    fresh = F.transform(F.filter(j["key_facts"], lambda x: x["fact"].isNotNull() & x["source"].isNotNull()), lambda x: F.concat_ws("|", x["fact"], x["source"], turn.cast("string")))
    return F.struct(F.coalesce(j["summary"], summary).alias("summary"), F.coalesce(fresh, facts).alias("facts"))


def merged_answer(library: Column, answer: Column) -> Column:
    return F.concat_ws("\n\n", F.nullif(library, F.lit("")), F.nullif(answer, F.lit("")))


def spliced(answer: Column, listing: Column) -> Column:
    """answer with listing as its own block where the first marker is, which a cut-off answer may end in the midst of; other markers go."""
    done = answer
    right = F.regexp_replace(answer, r"\s+$", "")
    for n in range(2, len(MARKER)):
        done = F.when(F.endswith(right, F.lit(MARKER[:n])), F.concat(F.substring(right, F.lit(1), F.length(right) - n), F.lit(MARKER))).otherwise(done)
    at = F.locate(MARKER, done)
    head = F.regexp_replace(F.substring(done, F.lit(1), at - 1), r"[ \t]+$", "")
    tail = F.regexp_replace(F.replace(F.substring(done, at + len(MARKER), F.length(done)), F.lit(MARKER)), r"^[ \t]+", "")
    block = F.concat(head, F.when((head != "") & ~F.endswith(head, F.lit("\n")), "\n\n").otherwise(""), listing, F.when(tail.rlike(r"\S") & ~F.startswith(tail, F.lit("\n")), "\n\n").otherwise(""), tail)
    return F.when(at > 0, block).otherwise(done)


def appended(turns: DataFrame, new: DataFrame) -> DataFrame:
    """turns and new (session_id, place, ...) ones, numbered on."""
    top = turns.groupBy("session_id").agg(F.max("turn_number").alias("_t"))
    numbered = ranked(new.join(top, "session_id", "left"), ["session_id"], F.col("place"), name="_n").withColumn("turn_number", F.coalesce("_t", F.lit(0)) + F.col("_n") + 1)
    return turns.unionByName(numbered.select(*turns.columns))


def expired(logins: DataFrame, now: Column, idle_hours: int = 12) -> DataFrame:
    """logins (id, last_seen, ends_at) that were idle for longer or are past their end."""
    return logins.where((F.col("last_seen") < now - F.make_dt_interval(F.lit(0), F.lit(idle_hours))) | (F.col("ends_at") < now))


def outcome(mode: Column, citations: Column, hints: Column) -> Column:
    """struct(used_rag, used_library, used_graph): what a turn ended with; retrieval without citations falls back to the library if hints say so."""
    fallback = (mode == "retrieval") & (citations == 0) & hints
    rag = mode.isin("retrieval", "compound")
    return F.struct((rag & ~fallback).alias("used_rag"), (mode.isin("library", "compound") | fallback).alias("used_library"), (rag & ~fallback & (citations > 0)).alias("used_graph"))
