"""Topics: greedy merge against the sequential rule, and the grouping of a small fleet."""

import random

from pyspark.sql import functions as F

from tracelake.functions.topic_text import title_tokens
from tracelake.operators import topics as TP


def greedy(rows, threshold=0.6):
    """The sequential rule: the first leading title at or above the threshold, else lead."""
    known, out = {}, {}
    for project, n, toks in rows:
        mine = set(toks)
        for lead in known.setdefault(project, []):
            if mine and lead and len(mine & lead) / len(mine | lead) >= threshold:
                out[n] = " ".join(sorted(lead))
                break
        else:
            known[project].append(mine)
            out[n] = " ".join(sorted(mine))
    return out


def test_merge_titles_is_the_sequential_rule(spark):
    rnd = random.Random(11)
    words = ["login", "page", "error", "billing", "export", "mail", "queue", "retry", "cache", "token"]
    titles = [" ".join(rnd.sample(words, rnd.randint(1, 5))) for _ in range(250)] + ["login page error hot%s" % "abcdefgh"[i % 8] for i in range(40)] + ["12"]
    rows = [("p" if i % 3 else "q", i, t) for i, t in enumerate(titles)]
    df = spark.createDataFrame(rows, "project string, n int, title string")
    toks = {r.n: r.t for r in df.select("n", title_tokens("title").alias("t")).collect()}
    want = greedy([(p, n, toks[n]) for p, n, _ in rows])
    got = {r.n: r.leader for r in TP.merge_titles(df, "title", ["project"], ["n"]).collect()}
    assert got == want


AGENT = (
    "session_id string, session_name string, provider string, cwd string, is_main boolean, git_branch string, last_prompt string, agent_key string, label string, state string, "
    "started_at bigint, last_activity_at bigint, cost_usd double, cost_partial boolean, worktree_branch string, last_action struct<tool:string,kind:string,target:string,dir:string>"
)


def agent(sid, key, label, name="session", branch=None, prompt=None, state="done", at=10, action=None, cwd="/w/proj"):
    main = key == "main"
    return (sid, name, "line_log", cwd, main, branch if main else None, prompt, key, label, state, at, at, 0.5, False, None if main else branch, action)


def test_build_topics(spark):
    rows = [
        agent("s1", "main", "m", name="PROJ-12: login redirect"),
        agent("s1", "a", "PROJ-12 check the tests"),
        agent("s2", "main", "m", name="nightly", prompt="look at proj-12 again"),
        agent("s3", "main", "m", name="Review"),
        *[agent("s3", f"k{i}", "PR #77 look") for i in range(3)],
        agent("s3", "k9", "unrelated billing export"),
        agent("s4", "main", "m", name="Big sweep", state="running", action=("Bash", "bash", "gh pr view 9", None)),
        *[agent("s4", f"z{i}", f"supabase item{'abcd'[i]} migrate{'wxyz'[i]}") for i in range(4)],
        agent("s4", "lone", "kubernetes ingress rollout"),
        agent("s4", "solo", "postgres vacuum tuning"),  # 4 of 7 loose agents share a word: at most 60 %
        agent("s5", "main", "m", name="billing export rounding"),
        agent("s6", "main", "m", name="billing export rounding bug", state="failed"),
    ]
    calls = spark.createDataFrame(
        [("s1", "a", 1, "edit", "/w/proj/src/modules/auth/x.ts", "/w/proj"), ("s1", "a", 2, "write", "/w/proj/src/modules/auth/y.ts", "/w/proj"), ("s2", "main", 1, "bash", "gh pr checks 5", "/w/proj")],
        "session_id string, agent_key string, ord int, kind string, target string, cwd string",
    )
    modules, prs = TP.action_memory(calls)
    agents = spark.createDataFrame(rows, AGENT)
    c = TP.assign_topics(agents, prs)
    slots = {(r.session_id, r.agent_key): r.slot for r in c.collect()}
    assert slots[("s1", "main")] == slots[("s1", "a")] == slots[("s2", "main")] == "t|proj|PROJ-12"
    assert slots[("s3", "k0")] == slots[("s3", "main")] == "p|proj|77"  # the main follows 3 of 4 sub-agents
    assert slots[("s4", "main")] == "r|proj" and slots[("s4", "z0")] == "c|proj|supab" and slots[("s4", "lone")] == "o|proj"
    assert slots[("s5", "main")] == slots[("s6", "main")] and slots[("s5", "main")].startswith("n|proj|")
    topics = TP.finish_topics(c, modules).cache()
    t = {r.slot: r for r in topics.collect()}
    p = t["t|proj|PROJ-12"]
    assert (p.kind, p.key, p.total, p.modules, p.title) == ("ticket", "PROJ-12", 3, ["src/modules/auth"], "check the tests")
    assert p.summary == "3 agents · modules: auth"
    assert (t["c|proj|supab"].title, t["r|proj"].title, t["o|proj"].title) == ("Supabase", "Orchestration · Big sweep", "Other · proj")
    assert t["r|proj"].recent == ["Running command gh pr view 9"] and t["r|proj"].running == 1
    members = TP.topic_members(c)
    hashed = TP.topic_hash(topics, members).cache()
    prompts = {r.topic_id: r.prompt for r in TP.prompt_rows(topics, members).collect()}
    assert "Topic: PROJ-12 check the tests" in prompts[p.topic_id] and len(prompts[p.topic_id]) <= 2000
    empty = spark.createDataFrame([], "topic_id string, at bigint")
    cache = hashed.where(F.col("slot") == "p|proj|77").select("topic_id", "facts_hash")
    offered = {r.slot for r in TP.summary_candidates(hashed, cache, empty, 1000).collect()}
    assert "o|proj" not in offered and "p|proj|77" not in offered and "t|proj|PROJ-12" in offered
    assert TP.summary_candidates(hashed, cache, empty, 1000, max_per_hour=1).count() == 1


def test_jaccard_pairs_against_brute_force(spark):
    rnd = random.Random(4)
    sets = [(i, sorted(rnd.sample("abcdefghijkl", rnd.randint(1, 7)))) for i in range(120)]
    got = {(r.id_a, r.id_b) for r in TP.jaccard_pairs(spark.createDataFrame(sets, "id int, tokens array<string>")).collect()}
    want = set()
    for j, b in sets:
        near = [(-len(set(a) & set(b)) / len(set(a) | set(b)), i) for i, a in sets if i < j]
        if near and -min(near)[0] >= 0.6:
            want.add((min(near)[1], j))
    assert got == want


def test_loose_labels_are_read_once(spark):
    """Words of a label are worked out before the steps that use them, and spelled as before: a word that does not count by itself shares the stem of one that does."""
    labels = ["strngate strngthss ledger", "Ledger strngate strngthss", "ledgers strngthss strngate", "ledger payment", "ledgers payment", "other things"]
    rows = [("s", f"k{n}", label, "other", "o|p", "", "p", False) for n, label in enumerate(labels)]
    c = spark.createDataFrame(rows, "session_id string, agent_key string, label string, kind string, slot string, title string, project string, is_main boolean")
    # 5 of 6 agents carry "ledge", which is too many; "strng" is carried by 3
    out = TP.cluster_loose(c)
    plan = out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "split(" not in plan and "label" in plan
    got = {r.agent_key: (r.kind, r.title, r.slot) for r in out.collect()}
    assert got == {f"k{n}": ("title", "Strngthss", "c|p|strng") if n < 3 else ("other", "", "o|p") for n in range(6)}
