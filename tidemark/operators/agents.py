"""Proposals against experience, relevance of edges, routes of queries, proofs of listed keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that turn a signal or a proposal around, and phrases that tell a route.
SIGNAL_NEGATIONS = ["not ", "don't", "avoid", "dislike", "stop", "reduce", "less ", "fewer"]
PROPOSAL_NEGATIONS = ["not ", "don't", "avoid", "remove", "reduce", "less "]
ROUTES = {
    "head": [
        "just said", "just told", "just mentioned", "a moment ago", "a minute ago", "earlier today", "earlier in this conversation", "what did i just", "what did we just",
        "you just said", "i just said", "the last thing", "most recent", "latest", "what was that", "say that again", "repeat that", "in this chat", "in this session",
        "so far today", "recap", "summarize this conversation", "summarize our conversation", "what have we discussed", "what have we talked about",
    ],
    "historical": [
        "remember when", "a long time ago", "months ago", "weeks ago", "years ago", "last year", "last month", "historically", "in the past", "originally", "used to",
        "back when", "at first", "initially", "what did i tell you about", "what did i say about", "you once told me", "a while back", "long ago", "way back",
        "do you recall", "do you remember", "first time we", "first time i", "early on", "how it all started", "beginning of", "timeline", "history of", "evolution of",
        "over time", "track record",
    ],
    "graph_focused": [
        "relationship between", "connected to", "related to", "how does .* relate", "who knows", "who works", "who is .* associated", "entities", "knowledge graph",
        "connection between", "link between", "network of", "map of", "all about", "everything about", "tell me about", "who are .* people", "what are .* things",
        "list of", "all the", "core beliefs", "values", "principles", "what does .* believe",
    ],
    "episode_recall": [
        "what did we discuss", "conversation about", "talked about", "meeting about", "discussion about", "that time we", "that conversation", "that session",
        "session about", "topic of", "when we talked", "when we discussed", "chat about", "chat history", "message history", "transcript", "conversation log",
    ],
}
HYBRID = 0.3


def _any(text: Column, phrases: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(text, p))


GRAM = 4


def _grams(chars: Column) -> Column:
    """All parts of GRAM characters, and the shorter ones of more than three bytes, since a word of so many may have fewer characters.

    chars: a column of a text's characters, not an expression that each part would compute anew.
    """

    def of(n: int) -> Column:
        at = F.when(F.size(chars) >= n, F.sequence(F.lit(1), F.size(chars) - (n - 1))).otherwise(F.array().cast("array<int>"))
        parts = F.transform(at, lambda i: F.concat(*(F.element_at(chars, i + k) for k in range(n))))
        return parts if n == GRAM else F.filter(parts, lambda p: F.octet_length(p) > 3)

    return F.array_distinct(F.concat(*(of(n) for n in range(1, GRAM + 1))))


def conflict_signals(proposals: DataFrame, events: DataFrame) -> DataFrame:
    """(proposal_id, event_id, conflicting) of each event of the proposal's agent that shares a word of over 3 bytes with it.

    A word is shared if some word of the proposal or of its candidate contains it. Null texts count as empty. Words that an agent's events have
    meet the proposals that have their first characters, by an index of these; only such pairs of a word and a proposal are
    compared, once for all events with the word.
    """
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    about = proposals.select("agent_id", "proposal_id", _any(low(F.col("proposal")), PROPOSAL_NEGATIONS).alias("denies"), F.concat_ws(" ", low(F.col("proposal")), low(F.col("candidate_core"))).alias("about"))
    said = events.select("agent_id", "event_id", low(F.col("signal")).alias("s"))
    words = F.filter(F.array_distinct(F.split("s", r"\s+")), lambda w: F.octet_length(w) > 3)
    spoken = said.select("agent_id", "event_id", _any(F.col("s"), SIGNAL_NEGATIONS).alias("negates"), F.explode(words).alias("word"))
    index = about.select("agent_id", "proposal_id", F.split("about", "").alias("chars")).select("agent_id", "proposal_id", F.explode(_grams(F.col("chars"))).alias("gram"))
    asked = spoken.select("agent_id", "word", F.substring("word", 1, GRAM).alias("gram")).distinct()
    near = asked.join(index, ["agent_id", "gram"]).select("agent_id", "proposal_id", "word")
    shared = near.join(about, ["agent_id", "proposal_id"]).where(F.contains(F.col("about"), F.col("word"))).select("agent_id", "proposal_id", "denies", "word")
    return spoken.join(shared, ["agent_id", "word"]).select("proposal_id", "event_id", (F.col("negates") != F.col("denies")).alias("conflicting")).distinct()


def conflict_analysis(proposals: DataFrame, events: DataFrame) -> DataFrame:
    """Every proposal with its counts of signals for and against it, the share of those against, and what to do."""
    counts = conflict_signals(proposals, events).groupBy("proposal_id").agg(F.count_if(~F.col("conflicting")).alias("supporting"), F.count_if("conflicting").alias("conflicting"))
    out = proposals.select("proposal_id").join(counts, "proposal_id", "left").fillna(0, ["supporting", "conflicting"])
    score = F.coalesce(F.try_divide("conflicting", F.col("supporting") + F.col("conflicting")), F.lit(0.0))
    advice = F.when(score < 0.3, "proceed").when(score < 0.7, "review_conflicts").otherwise("reject")
    return out.select("proposal_id", "supporting", "conflicting", F.round(score, 6).alias("conflict_score"), advice.alias("recommendation"))


def edge_rerank(edges: DataFrame, now: Column) -> DataFrame:
    """Relevance of each edge from confidence, age and corroboration, between 0 and 1."""
    days = F.greatest(F.lit(0), F.timestamp_diff("SECOND", F.col("ingested_at"), now)) / 86400.0
    score = 0.35 * F.col("confidence") + 0.35 * F.exp(-days / 120.0) + 0.3 * F.log1p("corroboration_count") / 4.0
    return edges.select("edge_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6).alias("relevance"))


def route(text: Column) -> Column:
    """struct(strategy, confidence): the strategy with the most telling phrases; hybrid has a floor, earlier ones win ties."""
    low = F.lower(F.coalesce(text, F.lit("")))

    def score(phrases: list[str]) -> Column:
        n = F.size(F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(low, p)))
        return F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), 0.35 + 0.15 * n))

    scores = [score(phrases) for phrases in ROUTES.values()] + [F.lit(HYBRID)]
    ranked = F.array_sort(F.array(*[F.struct((-s).alias("minus"), F.lit(i).alias("place"), F.lit(name).alias("strategy")) for i, (name, s) in enumerate(zip([*ROUTES, "hybrid"], scores, strict=True))]))
    margin = 2 * (ranked[1]["minus"] - ranked[0]["minus"])
    return F.struct(ranked[0]["strategy"].alias("strategy"), F.round(F.least(F.lit(1.0), margin), 6).alias("confidence"))


def proof_root(key: Column, siblings: Column) -> Column:
    """The root (hex) that a key and its siblings, array of struct(hash hex, left), fold to; a null sibling list is an empty one."""
    leaf = F.unhex(F.sha2(F.concat(F.lit("leaf:"), key), 256))
    node = lambda a, b: F.unhex(F.sha2(F.concat(F.lit("node:").cast("binary"), a, b), 256))
    step = lambda acc, s: F.when(s["left"], node(F.unhex(s["hash"]), acc)).otherwise(node(acc, F.unhex(s["hash"])))
    return F.lower(F.hex(F.aggregate(F.coalesce(siblings, F.array().cast("array<struct<hash:string,left:boolean>>")), leaf, step)))


def allowlist_proof_ok(key: Column, siblings: Column, root: Column) -> Column:
    return F.coalesce(proof_root(key, siblings) == F.lower(root), F.lit(False))
