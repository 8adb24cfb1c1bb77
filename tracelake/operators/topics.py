"""Topics: which work is going on, grouped by ticket, pull request or title.

Input is one row per agent (``AGENT_COLUMNS``); ``action_memory`` supplies what edits and commands show.
Every step is an aggregation or an equi join.  The greedy title merge is computed exactly in rounds of
joins, without listing the pairs of a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracelake.functions.text import describe_action, mask_secrets, nz
from tracelake.functions.topic_text import (
    STEM,
    clean_title,
    extract_tickets,
    informative_title,
    is_subject,
    is_title_word,
    loose_ticket_candidates,
    lower_tr,
    module_of,
    pr_from_command,
    prefix_of,
    project_of,
    prs_from_text,
    short_module,
    title_tokens,
    title_words,
    word_stems,
)
from tracelake.operators.components import components
from tracelake.operators.changes import facts_hash
from tracelake.session import cut_lineage

# --- fixed values ---------------------------------------------------------------------------------
MERGE_THRESHOLD = 0.6
MIN_CLUSTER, MIN_BUCKET, MAX_SHARE = 3, 5, 0.6
RARE = 1000  # sets that share a token, up to which it is an index key by itself; it decides what is compared, never what is found
COLLAPSE_GAIN = 0.5  # go on collapsing copies while a round settles half of what is open
SPREAD = 32  # tasks that share the agents of one word
MODULES_SHOWN, RECENT_SHOWN, TOPICS_OFFERED = 3, 3, 12
#: English labels (pass another map to localise).
LABELS = {
    "other": "Other",
    "orchestration": "Orchestration",
    "main": "Main agent",
    "agents": "agents",
    "running": "running",
    "failed": "failed",
    "last": "last",
    "modules": "modules",
    "instruction": (
        "Summarise this work topic: what is being done and where it stands; 1-2 sentences, present tense, a "
        "descriptive status summary. Use no imperative, no tools, no headings or lists; write only the summary.\n\n"
    ),
}
# --- end of fixed values --------------------------------------------------------------------------

AGENT_COLUMNS = (
    "session_id, session_name, provider, cwd, is_main, git_branch, last_prompt, agent_key, label, state, "
    "started_at, last_activity_at, cost_usd, cost_partial, worktree_branch, last_action"
).split(", ")
#: Input order of agents: sub-agents of all sessions before the mains, as the classification visits them.
ORDER = ("is_main", "session_id", "agent_key")
KEY = ("session_id", "agent_key")


def extract_keys(df: DataFrame, text: str) -> DataFrame:
    """Add the ticket keys and pull request numbers found in a text column."""
    return df.withColumns({"tickets": extract_tickets(text), "prs": prs_from_text(text)})


def loose_tickets(df: DataFrame, by: Sequence[str], text: str, prefixes: DataFrame) -> DataFrame:
    """Keys in any case whose prefix is in ``prefixes`` (column ``prefix``): (``by``, ``pos``, ``key``).

    The known prefixes are joined, not collected, so their number is free to grow.
    """
    rows = df.select(*by, F.posexplode(loose_ticket_candidates(text)).alias("pos", "key"))
    return rows.withColumn("prefix", prefix_of(F.col("key"))).join(prefixes, "prefix", "left_semi").drop("prefix")


def action_memory(calls: DataFrame, home: str = "") -> tuple[DataFrame, DataFrame]:
    """What the tool calls of each agent touched.

    ``calls``: session_id, agent_key, ord, kind, target, cwd.  Returns folder hits
    (session_id, agent_key, module, hits) and pull requests (session_id, agent_key, pr, ord of first use).
    """
    edits = calls.where(F.col("kind").isin("edit", "write") & nz("target").isNotNull())
    files = edits.select(*KEY, "cwd", F.explode(F.split("target", "\n")).alias("__f"))
    modules = files.select(*KEY, module_of("__f", "cwd", home).alias("module")).where(F.col("module").isNotNull())
    hits = modules.groupBy(*KEY, "module").agg(F.count(F.lit(1)).alias("hits"))
    pr = calls.where(F.col("kind") == "bash").select(*KEY, "ord", pr_from_command("target").alias("pr"))
    prs = pr.where(F.col("pr").isNotNull()).groupBy(*KEY, "pr").agg(F.min("ord").alias("ord"))
    return hits, prs


def known_prefixes(agents: DataFrame) -> DataFrame:
    text = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("session_name", "label", "git_branch", "worktree_branch")])
    return agents.select(F.explode(extract_tickets(text)).alias("key")).select(prefix_of(F.col("key")).alias("prefix")).distinct()


def _first(a: Column) -> Column:
    return F.try_element_at(a, F.lit(1))


def classify_agents(agents: DataFrame, prs: DataFrame | None = None, home: str = "") -> DataFrame:
    """Add project, kind, key, slot and title: ticket, then pull request, then informative title, then other."""
    subs = agents.groupBy("session_id").agg(F.count_if(~F.col("is_main")).alias("sub_count"))
    a = agents.join(subs, "session_id")
    if prs is not None:
        latest = prs.groupBy(*KEY).agg(F.max_by("pr", "ord").alias("seen_pr"))
        a = a.join(latest, list(KEY), "left")
    else:
        a = a.withColumn("seen_pr", F.lit(None).cast("int"))
    main = F.col("is_main")
    text = F.when(main, F.col("session_name")).otherwise(F.col("label"))
    branch = F.when(main, F.col("git_branch")).otherwise(F.col("worktree_branch"))
    a = a.withColumns(
        {
            "project": project_of("cwd", home),
            "__text": F.coalesce(text, F.lit("")),
            "__strict": F.coalesce(_first(extract_tickets(F.coalesce(text, F.lit("")))), _first(extract_tickets(F.coalesce(branch, F.lit(""))))),
            "__prompt": F.when(~(main & (F.col("sub_count") > 0)), F.col("last_prompt")),
        }
    )
    need = a.where(F.col("__strict").isNull() & nz("__prompt").isNotNull())
    found = loose_tickets(need, KEY, "__prompt", known_prefixes(agents)).groupBy(*KEY).agg(F.min_by("key", "pos").alias("__loose"))
    a = a.join(found, list(KEY), "left")
    # strict keys in the prompt come before loose ones
    ticket = F.coalesce("__strict", F.when(nz("__prompt").isNotNull(), _first(extract_tickets("__prompt"))), "__loose")
    shown = F.when(F.col("last_action.kind") == "bash", pr_from_command("last_action.target"))
    observed = F.when(~(main & (F.col("sub_count") >= 3)), F.coalesce(shown, "seen_pr"))
    a = a.withColumns({"__ticket": ticket, "__pr": F.coalesce(_first(prs_from_text("__text")), observed)})
    n = F.col("__pr").cast("string")
    kind = (
        F.when(F.col("__ticket").isNotNull(), "ticket")
        .when(F.col("__pr").isNotNull(), "pr")
        .when(informative_title("__text"), "title")
        .otherwise("other")
    )
    a = a.withColumn("kind", kind)
    project = F.col("project")
    return a.withColumns(
        {
            "key": F.when(F.col("kind") == "ticket", F.col("__ticket")).when(F.col("kind") == "pr", F.concat(F.lit("PR #"), n)),
            "slot": F.when(F.col("kind") == "ticket", F.concat_ws("|", F.lit("t"), project, F.col("__ticket")))
            .when(F.col("kind") == "pr", F.concat_ws("|", F.lit("p"), project, n))
            .when(F.col("kind") == "title", F.concat_ws("|", F.lit("n"), project))
            .otherwise(F.concat_ws("|", F.lit("o"), project)),
            "title": F.when(F.col("kind") == "ticket", clean_title("__text", [F.col("__ticket")]))
            .when(
                F.col("kind") == "pr",
                clean_title("__text", [F.concat(F.lit("PR #"), n), F.concat(F.lit("PR "), n), F.concat(F.lit("#"), n)]),
            )
            .when(F.col("kind") == "title", clean_title("__text"))
            .otherwise(F.lit("")),
        }
    ).drop("__text", "__strict", "__prompt", "__loose", "__ticket", "__pr", "seen_pr")


def assign_main_topics(c: DataFrame) -> DataFrame:
    """Mains without a topic of their own follow the ticket or pull request of half of their sub-agents.

    Otherwise a main with three or more sub-agents is orchestration, else it keeps its own class.
    """
    sub = c.where(~F.col("is_main") & F.col("kind").isin("ticket", "pr"))
    tally = sub.groupBy("session_id", "slot").agg(
        F.count(F.lit(1)).alias("n"), F.min_by(F.struct("agent_key", "kind", "key", "slot", "title", "project"), "agent_key").alias("lead")
    )
    top = tally.groupBy("session_id").agg(
        F.min_by(F.struct("n", "lead"), F.struct(-F.col("n"), F.col("lead.agent_key"))).alias("__top")
    )
    a = c.join(top, "session_id", "left")
    open_main = F.col("is_main") & (F.col("sub_count") > 0) & ~F.col("kind").isin("ticket", "pr")
    follows = open_main & F.coalesce(F.col("__top.n") / F.col("sub_count") >= 0.5, F.lit(False))
    conducts = open_main & ~follows & (F.col("sub_count") >= 3)
    lead = F.col("__top.lead")
    pick = lambda field, orch: F.when(follows, lead[field]).when(conducts, orch).otherwise(F.col(field))
    return a.select(
        *[x for x in c.columns if x not in ("kind", "key", "slot", "title", "project")],
        pick("kind", F.lit("orchestration")).alias("kind"),
        pick("key", F.lit(None).cast("string")).alias("key"),
        pick("slot", F.concat_ws("|", F.lit("r"), F.col("project"))).alias("slot"),
        pick("title", F.lit("")).alias("title"),
        pick("project", F.col("project")).alias("project"),
    )


def _overlap_needed(a: Column, b: Column, threshold: float) -> Column:
    """Tokens two sets of sizes a and b must share to reach the Jaccard threshold."""
    return F.ceil(F.lit(threshold) / F.lit(1 + threshold) * (a + b) - F.lit(1e-9)).cast("int")


def _sketch(tokens: Column | str) -> Column:
    """A word of bits of a set; bit k is the parity of the number of tokens whose hash falls on k."""
    bit = lambda t: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(t), F.lit(64)).cast("int"))
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda bits, t: bits.bitwiseXOR(bit(t)))


def similarity_keys(sets: DataFrame, id: str, tokens: str, scope: Sequence[str], threshold: float, carry: Sequence[str] = ()) -> DataFrame:
    """Index keys such that two sets at or above the threshold share at least one: ``key, id, n, m`` and ``carry``.

    Tokens are ordered from rare to frequent, and two similar sets meet under the first token that both hold.  If it is
    rare, it is a key by itself, else it counts together with the next token that both hold, which lies in a prefix as
    well.  n is the size of the set, m the place of the (first) token in it: a later place leaves too few tokens for a
    partner of some size.  The rows of a set depend on its own size only, not on its partners'.  A key is a
    hash, so a row holds no token; keys that only one set has are left out.
    """
    n, m, df = F.col("n"), F.col("m"), F.col("__t.df")
    exploded = sets.select(*scope, id, *carry, F.size(tokens).alias("n"), F.explode(tokens).alias("token"))
    freq = exploded.groupBy(*scope, "token").agg(F.count(F.lit(1)).alias("df"))
    # one row per set; a title has a bounded number of words
    ranked = exploded.join(freq, [*scope, "token"]).groupBy(*scope, id, *carry, "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("__r"))
    least = F.ceil(n * threshold - 1e-9).cast("int")  # tokens shared with the smallest partner
    first = n - least + 1
    placed = ranked.select("*", F.posexplode(F.slice("__r", F.lit(1), first)).alias("m", "__t"))
    kept = [id, *carry, "n", "m"]
    rare = placed.where(df <= RARE).select(F.xxhash64(*scope, "__t.token").alias("key"), *kept)
    pairs = F.transform(F.slice("__r", m + 2, first - m), lambda u: F.xxhash64(*scope, F.col("__t.token"), u["token"]))
    # where a single token may be all that is shared, it is a key for sets that small
    alone = F.when(least < 2, F.array(F.xxhash64(*scope, "__t.token"))).otherwise(F.array().cast("array<bigint>"))
    wide = placed.where(df > RARE).select(F.explode(F.concat(pairs, alone)).alias("key"), *kept)
    counted = rare.unionByName(wide).withColumn("__c", F.count(F.lit(1)).over(Window.partitionBy("key")))
    return counted.where("__c > 1").drop("__c")


def _can_match(threshold: float) -> Column:
    """Of two index rows a and b of one key: the sizes are near enough, and from their places on both have as many tokens as they must share."""
    fits = F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * threshold - 1e-9
    need = _overlap_needed(F.col("a.n"), F.col("b.n"), threshold)
    return (F.col("a.key") == F.col("b.key")) & fits & (need <= F.least(F.col("a.n") - F.col("a.m"), F.col("b.n") - F.col("b.m")))


def _sketches_allow(threshold: float) -> Column:
    """Of two index rows a and b with the ``__bits`` of their sets: the sketches differ in no more bits than similar sets differ in tokens.

    A token that only one of two sets has changes one bit of one sketch, so differing bits are never more than such tokens.
    """
    need = _overlap_needed(F.col("a.n"), F.col("b.n"), threshold)
    return F.bit_count(F.col("a.__bits").bitwiseXOR(F.col("b.__bits"))) <= F.col("a.n") + F.col("b.n") - 2 * need


def _verified(pairs: DataFrame, sets: DataFrame, id: str, tokens: str, scope: Sequence[str], threshold: float) -> DataFrame:
    """The pairs (a, b) of set ids whose sets are of one scope and similar, with their ``jaccard``."""
    own = lambda k: sets.select(F.col(id).alias(k), F.col(tokens).alias(f"__{k}"), *[F.col(c).alias(f"__{k}_{i}") for i, c in enumerate(scope)])
    both = pairs.join(own("a"), "a").join(own("b"), "b").withColumn("jaccard", _set_jaccard(F.col("__a"), F.col("__b")))
    for i in range(len(scope)):
        both = both.where(F.col(f"__a_{i}") == F.col(f"__b_{i}"))
    return both.where(F.col("jaccard") >= threshold).select("a", "b", "jaccard")


def _set_jaccard(a: Column, b: Column) -> Column:
    inter = F.size(F.array_intersect(a, b))
    return inter / (F.size(a) + F.size(b) - inter)


def merge_titles(
    c: DataFrame, title: str = "title", scope: Sequence[str] = ("project",), order: Sequence[str] = ORDER, threshold: float = MERGE_THRESHOLD
) -> DataFrame:
    """Greedy near-duplicate merge: each title joins the earliest leading title of its scope at or above
    the threshold, else it leads itself.  Adds ``leader`` (sorted tokens of the leading title).

    Works on distinct token sets, in rounds, with the result of the sequential rule.  First the sets that
    come first under *all* their index keys lead and take the sets similar to them, so a group of n near
    copies costs n comparisons.  When that stops paying, the similar pairs that are left (few, as copies
    are gone) decide the rest.
    """
    scope = list(scope)
    order_key = F.struct(*[F.col(x) for x in order])
    tokens = F.array_sort(title_tokens(title))
    rows = c.withColumn("__tokens", tokens)
    sets = cut_lineage(rows.groupBy(*scope, "__tokens").agg(F.min(order_key).alias("ord")).withColumn("uid", F.monotonically_increasing_id()))
    # the index works on numbers: uid is a set, at its place in the order
    places = cut_lineage(sets.select("ord").distinct().orderBy("ord").withColumn("at", F.monotonically_increasing_id()))
    some = cut_lineage(sets.where(F.size("__tokens") > 0).join(places, "ord").select("uid", "at", *scope, "__tokens"))
    keys = cut_lineage(similarity_keys(some.withColumn("__bits", _sketch("__tokens")), "uid", "__tokens", scope, threshold, ["at", "__bits"]))
    similar = lambda pairs: _verified(cut_lineage(pairs.distinct()), some, "uid", "__tokens", scope, threshold)
    meet = _can_match(threshold) & _sketches_allow(threshold)
    # a set that meets no other leads itself
    undecided = cut_lineage(keys.select("uid").distinct())
    leaders = cut_lineage(some.select("uid").join(undecided, "uid", "left_anti"))
    left = undecided.count()
    # 1) collapse groups of near copies: compare each index group with its first set only, while that pays
    while left:
        live = keys.join(undecided, "uid", "left_semi")
        first = live.groupBy("key").agg(F.min("at").alias("__first"))
        front = live.join(first, "key").groupBy("uid").agg(F.bool_and(F.col("at") == F.col("__first")).alias("__lead"))
        new = cut_lineage(front.where("__lead").select("uid"))
        leaders = leaders.unionByName(new)
        near = live.alias("b").join(live.join(new, "uid", "left_semi").alias("a"), meet & (F.col("b.at") > F.col("a.at")))
        gone = similar(near.select(F.col("a.uid").alias("a"), F.col("b.uid").alias("b"))).select(F.col("b").alias("uid")).unionByName(new).distinct()
        undecided = cut_lineage(undecided.join(gone, "uid", "left_anti"))
        before, left = left, undecided.count()
        if left > before * COLLAPSE_GAIN:
            break
    # 2) what is left has few similar pairs: a set leads when no earlier similar set is undecided or leads
    if left:
        live = keys.join(undecided, "uid", "left_semi")
        near = live.alias("a").join(live.alias("b"), meet & (F.col("b.at") > F.col("a.at")))
        pairs = cut_lineage(similar(near.select(F.col("a.uid").alias("a"), F.col("b.uid").alias("b"))).select("a", "b"))
        while left:
            waiting = pairs.join(undecided.withColumnRenamed("uid", "a"), "a", "left_semi").select(F.col("b").alias("uid"))
            new = cut_lineage(undecided.join(waiting, "uid", "left_anti"))
            leaders = leaders.unionByName(new)
            members = pairs.join(new.withColumnRenamed("uid", "a"), "a", "left_semi").select(F.col("b").alias("uid"))
            undecided = cut_lineage(undecided.join(new.unionByName(members).distinct(), "uid", "left_anti"))
            left = undecided.count()
    leaders = cut_lineage(leaders)
    led, others = keys.join(leaders, "uid", "left_semi"), keys.join(leaders, "uid", "left_anti")
    near = others.alias("b").join(led.alias("a"), meet & (F.col("b.at") > F.col("a.at")))
    near = similar(near.select(F.col("a.uid").alias("a"), F.col("b.uid").alias("b")))
    best = near.join(some.select(F.col("uid").alias("a"), "at"), "a").groupBy(F.col("b").alias("uid")).agg(F.min_by("a", "at").alias("__lead"))
    text = F.array_join("__tokens", " ")
    lead = best.join(some.select(F.col("uid").alias("__lead"), text.alias("__name")), "__lead").select("uid", "__name")
    found = sets.join(lead, "uid", "left").select(*scope, text.alias("id"), F.coalesce("__name", text).alias("leader"))
    return rows.withColumn("id", text).join(found, [*scope, "id"]).drop("id", "__tokens")


def similar_pairs(sets: DataFrame, id: str = "id", tokens: str = "tokens", scope: Sequence[str] = (), threshold: float = MERGE_THRESHOLD) -> DataFrame:
    """All pairs (``id_a`` < ``id_b``) of sets of one scope whose Jaccard similarity reaches the threshold, with it.

    Two similar sets meet under a key of :func:`similarity_keys`, whose rows hold no set.  Most pairs that meet are ruled out
    by sketches inside the join and never written.  Only the tokens of those that are left are fetched.
    """
    scope = list(scope)
    s = sets.withColumn(tokens, F.array_distinct(tokens)).where(F.size(tokens) > 0).select(*scope, id, tokens)
    s = cut_lineage(s.withColumn("__uid", F.monotonically_increasing_id()))
    keys = similarity_keys(s.withColumn("__bits", _sketch(tokens)), "__uid", tokens, scope, threshold, ["__bits"])
    met = keys.alias("a").join(keys.alias("b"), _can_match(threshold) & _sketches_allow(threshold) & (F.col("a.__uid") < F.col("b.__uid")))
    met = cut_lineage(met.select(F.col("a.__uid").alias("a"), F.col("b.__uid").alias("b")).distinct())
    pairs = _verified(met, s, "__uid", tokens, scope, threshold)
    name = lambda k: s.select(F.col("__uid").alias(k), *(scope if k == "a" else []), F.col(id).alias(f"__{k}"))
    named = pairs.join(name("a"), "a").join(name("b"), "b").where("__a <> __b")
    return named.select(*scope, F.least("__a", "__b").alias("id_a"), F.greatest("__a", "__b").alias("id_b"), "jaccard")


def jaccard_pairs(sets: DataFrame, id: str = "id", tokens: str = "tokens", scope: Sequence[str] = (), threshold: float = MERGE_THRESHOLD) -> DataFrame:
    """Each token set (``id_b``) with the most similar earlier set at or above the threshold (the smallest id among equals).

    That is one link per set; which sets belong together by all links says :func:`jaccard_groups`.
    """
    scope = list(scope)
    best = F.min_by(F.struct("id_a", "jaccard"), F.struct(-F.col("jaccard"), F.col("id_a"))).alias("__best")
    found = similar_pairs(sets, id, tokens, scope, threshold).groupBy(*scope, "id_b").agg(best)
    return found.select(*scope, "__best.id_a", "id_b", "__best.jaccard")


def jaccard_groups(sets: DataFrame, id: str = "id", tokens: str = "tokens", scope: Sequence[str] = (), threshold: float = MERGE_THRESHOLD) -> DataFrame:
    """Every token set with its number of ``links`` and its ``group``: the smallest id that links reach, itself included.

    Ids must be unique over all scopes.
    """
    pairs = cut_lineage(similar_pairs(sets, id, tokens, scope, threshold).select("id_a", "id_b"))
    ends = pairs.select(F.explode(F.array("id_a", "id_b")).alias(id)).groupBy(id).agg(F.count(F.lit(1)).alias("links"))
    roots = components(pairs, "id_a", "id_b").withColumnRenamed("node", id)
    out = sets.select(*scope, id).join(ends, id, "left").join(roots, id, "left")
    return out.select(*scope, id, F.coalesce("links", F.lit(0)).cast("bigint").alias("links"), F.coalesce("root", id).alias("group"))


def title_slots(c: DataFrame, threshold: float = MERGE_THRESHOLD) -> DataFrame:
    """Merge titles, then send a title with a single member that is no main to ``other``."""
    titled = merge_titles(c.where(F.col("kind") == "title"), threshold=threshold)
    titled = titled.withColumn("slot", F.concat_ws("|", F.lit("n"), F.col("project"), F.col("leader"))).drop("leader")
    sizes = titled.groupBy("slot").agg(F.count(F.lit(1)).alias("__n"), F.bool_or("is_main").alias("__main"))
    weak = (F.col("__n") < 2) & ~F.col("__main")
    out = titled.join(sizes, "slot").withColumns(
        {
            "kind": F.when(weak, F.lit("other")).otherwise(F.col("kind")),
            "slot": F.when(weak, F.concat_ws("|", F.lit("o"), F.col("project"))).otherwise(F.col("slot")),
        }
    )
    return c.where(F.col("kind") != "title").unionByName(out.select(*c.columns))


def _spread_join(rows: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """Inner join of agents' rows with a small table: the rows of one key are dealt to ``SPREAD`` tasks."""
    salt = F.pmod(F.xxhash64(*KEY), F.lit(SPREAD)).cast("int")
    copies = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return rows.withColumn("__salt", salt).join(copies, [*on, "__salt"]).drop("__salt")


def cluster_loose(c: DataFrame) -> DataFrame:
    """Keyless sub-agents that share a distinctive word become a topic of their own.

    A word counts when 3 to 60 % of the bucket's sub-agents carry it; an agent joins its most widespread
    word (longer first, then earlier in its label); clusters that end up below three agents give their members back.
    """
    is_loose = (F.col("kind") == "other") & ~F.col("is_main")
    # every label is read once: the steps below use its words several times
    sub = c.where(is_loose).select("slot", *KEY, title_words("label").alias("__all"))
    sub = sub.select("slot", *KEY, F.filter(word_stems(F.col("__all")), is_subject).alias("__words"), "__all")
    # full words of the stems; a word that counts has its stem there, others may share one
    stem = lambda w: F.substring(w, 1, STEM)
    full = lambda w: (F.length(w) >= 3) & is_subject(stem(w)) & (is_title_word(w) | F.array_contains(F.col("__words"), stem(w)))
    sub = cut_lineage(sub.select("slot", *KEY, "__words", F.filter("__all", full).alias("__full")))
    sizes = sub.groupBy("slot").agg(F.count(F.lit(1)).alias("__size"))
    words = sub.select("slot", *KEY, F.posexplode("__words").alias("pos", "word"))
    freq = words.groupBy("slot", "word").agg(F.count(F.lit(1)).alias("df")).join(sizes, "slot")
    usable = freq.where(
        (F.col("__size") >= MIN_BUCKET) & (F.col("df") >= MIN_CLUSTER) & (F.col("df") <= F.col("__size") * MAX_SHARE)
    )
    best = _spread_join(words, usable, ["slot", "word"]).groupBy("slot", *KEY).agg(
        F.min_by("word", F.struct(-F.col("df"), -F.length("word"), F.col("pos"))).alias("word")
    )
    keep = best.groupBy("slot", "word").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= MIN_CLUSTER).drop("__n")
    # the word as people write it: the most frequent full form, the longest among equals
    spelled = sub.select("slot", F.explode("__full").alias("full")).withColumn("word", F.substring("full", 1, STEM))
    forms = spelled.groupBy("slot", "word", "full").agg(F.count(F.lit(1)).alias("n"))
    name = forms.groupBy("slot", "word").agg(
        F.min_by("full", F.struct(-F.col("n"), -F.length("full"), F.col("full"))).alias("__name")
    )
    moved = _spread_join(best, keep.join(name, ["slot", "word"], "left"), ["slot", "word"])
    a = c.join(moved, ["slot", *KEY], "left")
    hit = is_loose & F.col("word").isNotNull()
    shown = F.coalesce("__name", "word")
    head = F.upper(F.translate(F.substring(shown, 1, 1), "iı", "İI"))
    return a.withColumns(
        {
            "kind": F.when(hit, F.lit("title")).otherwise(F.col("kind")),
            "title": F.when(hit, F.concat(head, F.substring(shown, 2, 1000))).otherwise(F.col("title")),
            "slot": F.when(hit, F.concat_ws("|", F.lit("c"), F.col("project"), F.col("word"))).otherwise(F.col("slot")),
        }
    ).select(*c.columns)


def topic_members(c: DataFrame, limit: int | None = None, labels: dict[str, str] | None = None) -> DataFrame:
    """The agents of each topic in order (of these the first ``limit``, if given): running ones first, then the latest activity."""
    labels = labels or LABELS
    busy = F.col("state").isin("running", "stalled")
    w = Window.partitionBy("slot").orderBy(busy.desc(), F.coalesce("last_activity_at", F.lit(0)).desc(), *ORDER)
    rows = c.withColumn("place", F.row_number().over(w))
    if limit is not None:
        rows = rows.where(F.col("place") <= limit)
    shown = F.when(F.col("is_main"), F.lit(labels["main"])).otherwise(F.col("label"))
    return rows.select(
        F.substring(F.sha1("slot"), 1, 10).alias("topic_id"),
        "slot",
        "place",
        "session_id",
        "session_name",
        "agent_key",
        shown.alias("label"),
        "provider",
        "state",
        "is_main",
        F.coalesce("last_activity_at", F.lit(0)).alias("last_activity_at"),
    )


def _titles(c: DataFrame) -> DataFrame:
    """Per slot the most frequent title (longest, then first); sub-agents speak before mains."""
    named = c.where(nz("title").isNotNull()).withColumn("__low", lower_tr("title"))
    freq = named.groupBy("slot", "is_main", "__low").agg(F.count(F.lit(1)).alias("__n"))
    best = F.struct(F.col("is_main"), -F.col("__n"), -F.length("title"), *[F.col(x) for x in ORDER[1:]])
    return named.join(freq, ["slot", "is_main", "__low"]).groupBy("slot").agg(F.min_by("title", best).alias("__title"))


def finish_topics(c: DataFrame, modules: DataFrame | None = None, labels: dict[str, str] | None = None, verbs: dict[str, str] | None = None) -> DataFrame:
    """One row per slot: title, counts, times, cost, modules, recent actions, one-line summary."""
    labels = labels or LABELS
    at = F.coalesce("last_activity_at", "started_at", F.lit(0))
    busy = F.col("state").isin("running", "stalled")
    order = F.struct(*ORDER)
    money = F.coalesce(F.col("cost_usd"), F.lit(0.0)).cast("decimal(24,9)")
    base = c.groupBy("slot").agg(
        F.min_by("kind", order).alias("__kind"),
        F.min_by("key", order).alias("__key"),
        F.min_by("project", order).alias("project"),
        F.min_by("session_name", order).alias("__session"),
        F.count_distinct("session_name").alias("__sessions"),
        F.array_sort(F.collect_set("provider")).alias("providers"),
        F.count_if(busy).alias("running"),
        F.count_if(F.col("state") == "failed").alias("failed"),
        F.count(F.lit(1)).alias("total"),
        F.min(F.coalesce(F.col("started_at"), at)).alias("first_at"),
        F.max(at).alias("last_at"),
        F.sum(money).cast("double").alias("cost_usd"),
        F.bool_or(F.coalesce("cost_partial", F.lit(False))).alias("cost_partial"),
    )
    text = describe_action(F.col("last_action.kind"), F.col("last_action.target"), F.col("last_action.tool"), verbs)
    latest = Window.partitionBy("slot").orderBy(F.col("__at").desc(), *ORDER)
    recent = (
        c.where(busy & F.col("last_action").isNotNull())
        .select("slot", *ORDER, at.alias("__at"), text.alias("__text"))
        .withColumn("__r", F.row_number().over(latest))
        .where(F.col("__r") <= RECENT_SHOWN)
        .groupBy("slot")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", "__text"))), lambda x: x["__text"]).alias("recent"))
    )
    out = base.join(_titles(c), "slot", "left").join(recent, "slot", "left")
    if modules is not None:
        hits = c.select("slot", *KEY).join(modules, list(KEY)).groupBy("slot", "module").agg(F.sum("hits").alias("hits"))
        w = Window.partitionBy("slot").orderBy(F.col("hits").desc(), "module")
        top = (
            hits.withColumn("__r", F.row_number().over(w))
            .where(F.col("__r") <= MODULES_SHOWN)
            .groupBy("slot")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", "module"))), lambda x: x["module"]).alias("modules"))
        )
        out = out.join(top, "slot", "left")
    else:
        out = out.withColumn("modules", F.array().cast("array<string>"))
    empty = F.array().cast("array<string>")
    kind = (
        F.when((F.col("__kind") == "other") | F.startswith(F.col("slot"), F.lit("o|")), F.lit("other"))
        .when(F.startswith(F.col("slot"), F.lit("r|")), F.lit("orchestration"))
        .otherwise(F.col("__kind"))
    )
    extra = F.when(F.col("__sessions") > 1, F.concat(F.lit(" +"), (F.col("__sessions") - 1).cast("string"))).otherwise(F.lit(""))
    out = out.withColumns({"kind": kind, "modules": F.coalesce("modules", empty), "recent": F.coalesce("recent", empty)})
    out = out.withColumns(
        {
            "topic_id": F.substring(F.sha1("slot"), 1, 10),
            "key": F.when(F.col("kind").isin("ticket", "pr"), F.col("__key")),
            "done": F.col("total") - F.col("running") - F.col("failed"),
            "title": F.when(F.col("kind") == "other", F.concat_ws(" · ", F.lit(labels["other"]), "project"))
            .when(
                F.col("kind") == "orchestration",
                F.concat(F.lit(labels["orchestration"] + " · "), F.substring(clean_title("__session"), 1, 40), extra),
            )
            .otherwise(F.coalesce("__title", "__key", "project")),
        }
    )
    return out.withColumn("summary", summarize_topic(labels)).select(
        "topic_id", "slot", "kind", "key", "title", "project", "providers", "running", "done", "failed", "total",
        "first_at", "last_at", "cost_usd", "cost_partial", "modules", "recent", "summary",
    )


def summarize_topic(labels: dict[str, str] | None = None) -> Column:
    """The deterministic one-liner of a topic."""
    labels = labels or LABELS
    n = lambda c, word: F.concat(F.col(c).cast("string"), F.lit(f" {labels[word]}"))
    return F.concat_ws(
        " · ",
        n("total", "agents"),
        F.when(F.col("running") > 0, n("running", "running")),
        F.when(F.col("failed") > 0, n("failed", "failed")),
        F.when(F.size("recent") > 0, F.concat(F.lit(labels["last"] + ": "), _first(F.col("recent")))),
        F.when(
            F.size("modules") > 0,
            F.concat(F.lit(labels["modules"] + ": "), F.array_join(F.transform("modules", short_module), ", ")),
        ),
    )


def window_agents(agents: DataFrame, now: int, window_ms: int) -> DataFrame:
    """Agents in the window: running, active since the cut-off, or the main of a live session."""
    cutoff = now - window_ms
    at = F.coalesce("last_activity_at", "ended_at", "started_at", F.lit(0)) if "ended_at" in agents.columns else F.coalesce(
        "last_activity_at", "started_at", F.lit(0)
    )
    live = F.coalesce(F.col("live"), F.lit(False)) if "live" in agents.columns else F.lit(False)
    return agents.where(F.col("state").isin("running", "stalled") | (at >= cutoff) | (F.col("is_main") & live))


def assign_topics(agents: DataFrame, prs: DataFrame | None = None, home: str = "") -> DataFrame:
    """The agents with their final topic slot.

    The classified agents (texts already read) and the merged slots are written once, because the steps
    after them use their input several times.
    """
    classified = cut_lineage(classify_agents(agents, prs, home))
    return cut_lineage(cluster_loose(cut_lineage(title_slots(assign_main_topics(classified)))))


def build_topics(
    agents: DataFrame,
    modules: DataFrame | None = None,
    prs: DataFrame | None = None,
    home: str = "",
    labels: dict[str, str] | None = None,
    verbs: dict[str, str] | None = None,
) -> DataFrame:
    return finish_topics(assign_topics(agents, prs, home), modules, labels, verbs)


def order_topics(topics: DataFrame) -> DataFrame:
    """Running topics first, then the latest activity; ``other`` buckets last."""
    return topics.orderBy((F.col("kind") == "other").asc(), (F.col("running") > 0).desc(), F.col("last_at").desc(), "topic_id")


def topic_hash(topics: DataFrame, members: DataFrame) -> DataFrame:
    """A digest of all agents of each topic, their states, its last activity and counts.

    Row digests are added up, so no topic's members are gathered.
    """
    who = facts_hash(members, ["topic_id"], ["session_id", "agent_key", "state"]).select("topic_id", F.col("facts_hash").alias("__who"))
    text = F.concat_ws("|", "__who", *[F.col(c).cast("string") for c in ("last_at", "running", "done", "failed")])
    return topics.join(who, "topic_id").withColumn("facts_hash", F.substring(F.sha1(text), 1, 16)).drop("__who")


def prompt_rows(topics: DataFrame, members: DataFrame, labels: dict[str, str] | None = None, max_labels: int | None = None, max_chars: int | None = None) -> DataFrame:
    """The masked facts of each topic as text; the number of tasks and the length can be limited for a model."""
    labels = labels or LABELS
    sub = members.where(~F.col("is_main"))
    w = Window.partitionBy("topic_id").orderBy("place")
    lines = (
        sub.withColumn("__r", F.row_number().over(w))
        .where(F.col("__r") <= max_labels if max_labels is not None else F.lit(True))
        .groupBy("topic_id")
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("__r", F.concat(F.lit("- ["), "state", F.lit("] "), "label").alias("t")))), lambda x: x["t"]
            ).alias("__labels")
        )
    )
    t = topics.join(lines, "topic_id", "left")
    bullet = lambda c: F.transform(c, lambda x: F.concat(F.lit("- "), x))
    s = lambda c: F.col(c).cast("string")
    counts = F.concat(
        F.lit("Agents: "), s("total"), F.lit(" (running "), s("running"), F.lit(", done "), s("done"), F.lit(", failed "), s("failed"), F.lit(")")
    )
    facts = F.concat_ws(
        "\n",
        F.concat(F.lit("Topic: "), F.concat_ws(" ", "key", "title")),
        F.concat(F.lit("Project: "), "project"),
        counts,
        F.when(F.size("__labels") > 0, F.concat_ws("\n", F.lit("Sub-agent tasks:"), F.col("__labels"))),
        F.when(F.size("recent") > 0, F.concat_ws("\n", F.lit("Latest actions:"), bullet("recent"))),
        F.when(F.size("modules") > 0, F.concat(F.lit("Touched modules: "), F.array_join("modules", ", "))),
    )
    masked = mask_secrets(facts)
    cut = masked
    if max_chars is not None:
        room = max_chars - len(labels["instruction"])
        cut = F.when(F.length(masked) > room, F.concat(F.substring(masked, 1, room - 1), F.lit("…"))).otherwise(masked)
    return t.select("topic_id", F.concat(F.lit(labels["instruction"]), cut).alias("prompt"))


def summary_candidates(
    topics: DataFrame,
    cache: DataFrame,
    calls: DataFrame,
    now: int,
    active_ms: int = 7_200_000,
    debounce_ms: int = 600_000,
    max_per_hour: int = 20,
    offered: int = TOPICS_OFFERED,
) -> DataFrame:
    """Topics (with ``facts_hash``) to summarise now.

    Of the first ``offered`` topics in display order: not ``other``, running or recently active, changed
    since the cached summary (``cache``: topic_id, facts_hash), not tried within the debounce time, and
    within what is left of the hourly budget (``calls``: topic_id, at).
    """
    first = order_topics(topics).limit(offered)
    used = calls.where(F.col("at") > now - 3_600_000).agg(F.count(F.lit(1)).alias("__used"))
    tried = calls.groupBy("topic_id").agg(F.max("at").alias("__tried"))
    rows = first.where((F.col("kind") != "other") & ((F.col("running") > 0) | (F.lit(now) - F.col("last_at") <= active_ms)))
    rows = rows.join(cache.select("topic_id", "facts_hash"), ["topic_id", "facts_hash"], "left_anti")
    rows = rows.join(tried, "topic_id", "left").where(F.col("__tried").isNull() | (F.lit(now) - F.col("__tried") >= debounce_ms))
    # at most ``offered`` rows are left here
    place = F.row_number().over(Window.orderBy((F.col("running") > 0).desc(), F.col("last_at").desc(), "topic_id"))
    rows = rows.withColumn("place", place).join(used, F.lit(True))
    return rows.where(F.col("place") <= F.lit(max_per_hour) - F.col("__used")).drop("__used", "__tried")


def attach_summaries(topics: DataFrame, cache: DataFrame) -> DataFrame:
    return topics.join(cache.select("topic_id", F.col("text").alias("summary_text"), F.col("at").alias("summary_at")), "topic_id", "left")


def summarize_with(prompts: DataFrame, fn, as_: str = "text", max_chars: int | None = None) -> DataFrame:
    """Run a summary backend, given as a pandas UDF from prompt text to summary text; masked, then cut if asked for."""
    one = F.regexp_replace(F.trim(fn(F.col("prompt"))), "\\s+", " ")
    out = mask_secrets(one)
    if max_chars is not None:
        out = F.when(F.length(out) > max_chars, F.concat(F.substring(out, 1, max_chars - 1), F.lit("…"))).otherwise(out)
    return prompts.withColumn(as_, out)


def calls_last_hour(calls: DataFrame, now: int) -> DataFrame:
    return calls.where(F.col("at") > now - 3_600_000).agg(F.count(F.lit(1)).alias("calls_last_hour"))

