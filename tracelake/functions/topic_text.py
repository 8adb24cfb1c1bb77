"""Columns that read topic signals (ticket keys, pull requests, modules, title words) from text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tracelake.functions.text import WS, WS_CHARS, WS_SIGNS, bound, col, js_trim, let

# --- fixed values: word lists -----------------------------------------------------------------------
#: Prefixes that look like ticket keys but are standards, algorithms or versions.
TICKET_STOP = [
    "UTF", "SHA", "ISO", "HTTP", "HTTPS", "TLS", "SSL", "RFC", "CVE", "AES", "RSA", "MD", "IPV", "GPT", "ECMA", "TCP", "UDP", "HS", "RS",
    "ES", "PBKDF", "COVID", "SQL", "PDF", "USB", "WIN", "ASCII", "BASE", "OAUTH", "H", "X", "IEEE", "ANSI", "RGB", "HSL", "CRC", "BLAKE",
    "SHAKE", "HMAC", "ARM", "AMD", "GHSA", "PEP", "NODE", "PYTHON", "LLAMA", "CLAUDE", "OPUS", "SONNET", "HAIKU", "QWEN", "GEMINI",
    "CODEX", "UNICODE", "UTC", "GMT", "OS", "IOS", "MACOS", "ED", "ECDSA", "EC", "SM", "DES", "RC", "CBC", "GCM", "CTR", "ECB", "POSIX",
    "LTS", "TS", "JS", "CSS", "HTML",
]
#: Words that never count as title words.
TITLE_STOP = [
    "the", "and", "for", "with", "from", "into", "that", "this", "fix", "add", "update", "check", "run", "make", "use", "new", "all",
    "not", "are", "bir", "ile", "için", "ve", "bu", "şu", "her", "den", "dan", "gibi", "daha", "olan", "yap", "yapma", "kontrol", "et",
    "ama", "veya", "sonra", "önce",
]
#: Greetings and placeholders: a title made of these says nothing.
GENERIC_WORDS = [
    "selam", "merhaba", "naber", "canım", "master", "masteng", "greeting", "casual", "turkish", "hello", "goal", "test", "deneme", "yeni",
    "sohbet", "chat", "session", "oturum", "selamlaşma",
]
#: Words of development work that say nothing about the subject.
DEV_WORDS = [
    "remove", "verify", "check", "audit", "scan", "build", "refresh", "update", "write", "gather", "measure", "declare", "bump", "prune",
    "only", "page", "pages", "analysis", "review", "plan", "investigation", "cleanup", "clean", "sweep", "alert", "done", "read", "prod",
    "production", "with", "after", "before", "other", "finish", "compress", "apply", "state", "issue", "issues", "work", "kontrol",
    "incele", "inceleme", "düzelt", "ekle", "sil", "tara", "ölç", "hazırla", "bitir", "sonra", "önce", "test", "tests", "script", "config",
    "code", "case", "cases", "part", "parts", "slice", "step", "steps", "task", "tasks", "final", "full", "real", "data", "make", "sure",
    "ready", "readiness",
]
#: Flags of the pull request command that take a value.
PR_VALUE_FLAGS = [
    "--limit", "-L", "--json", "--jq", "-q", "--repo", "-R", "--body", "-b", "--title", "-t", "--base", "-B", "--head", "-H", "--search",
    "-S", "--state", "-s", "--author", "-A", "--label", "-l", "--assignee", "-a", "--template", "-p", "--milestone", "-m",
]
#: Trailing folders that are dropped from a module path, and structural folders dropped from its short name.
MODULE_TAIL = [
    "__tests__", "tests", "test", "spec", "__mocks__", "fixtures", "dist", "build",
]
MODULE_SKIP = [
    "apps", "packages", "libs", "lib", "src", "modules", "app", "source",
]
STEM = 5
# --- end of fixed values ------------------------------------------------------------------------------

GENERIC_STEMS = sorted({w[:STEM] for w in GENERIC_WORDS})
DEV_STEMS = sorted({w[:STEM] for w in DEV_WORDS})
_TICKET = "(?<![A-Za-z0-9_])([A-Z][A-Z0-9]+)-(\\d{1,6})(?![A-Za-z0-9]|-\\d)"
_LOOSE = "(?<![A-Za-z0-9_-])([A-Za-z][A-Za-z0-9]+)-(\\d{1,6})(?![A-Za-z0-9]|-\\d)"


def prefix_of(key: Column) -> Column:
    return F.substring_index(key, "-", 1)


def extract_tickets(c: Column | str) -> Column:
    """Distinct ticket keys in order of appearance."""
    keys = F.regexp_extract_all(col(c), F.lit(_TICKET), F.lit(0))
    keep = lambda k: ~prefix_of(k).isin(TICKET_STOP) & (F.length(prefix_of(k)) <= 10)
    return F.array_distinct(F.filter(keys, keep))


def loose_ticket_candidates(c: Column | str) -> Column:
    """Ticket-like keys in any case, upper-cased; they count only when their prefix is known from elsewhere."""
    keys = F.regexp_extract_all(col(c), F.lit(_LOOSE), F.lit(0))
    return F.array_distinct(F.transform(keys, F.upper))


@bound
def prs_from_text(c: Column | str) -> Column:
    """Pull request numbers named in text: every ``PR n`` first, then every ``#n``."""
    c = col(c)
    named = F.regexp_extract_all(c, F.lit("(?i)(?<!\\w)PRs?" + WS + "*#?(\\d{1,6})(?!\\w)"), F.lit(1))
    hashed = F.regexp_extract_all(c, F.lit("(?<![\\w&])#(\\d{1,6})(?!\\w)"), F.lit(1))
    numbers = F.transform(F.concat(named, hashed), lambda n: n.cast("int"))
    return F.array_distinct(F.filter(numbers, lambda n: n > 0))


@bound
def pr_from_command(c: Column | str) -> Column:
    """The pull request a shell command is about, or null."""
    c = col(c)
    url = F.regexp_extract(c, "/pull/(\\d{1,6})(?!\\w)", 1)
    args = F.regexp_extract(c, f"(?s)(?<!\\w)gh{WS}+pr{WS}+(.*)", 1)
    tokens = F.split(args, f"[{WS_CHARS};|&]+")
    tokens = F.filter(tokens, lambda _, i: i >= 1)  # the first one is the sub-command

    def step(acc: Column, t: Column) -> Column:
        number = F.coalesce(
            F.nullif(F.regexp_extract(t, "^#?(\\d{1,6})\\z", 1), F.lit("")),
            F.nullif(F.regexp_extract(t, "/pull/(\\d{1,6})", 1), F.lit("")),
        ).cast("int")
        flag = F.startswith(t, F.lit("-"))
        done = acc["found"].isNotNull()
        return F.struct(
            (~done & ~acc["skip"] & flag & t.isin(PR_VALUE_FLAGS)).alias("skip"),
            F.when(done, acc["found"]).when(acc["skip"] | flag, F.lit(None).cast("int")).otherwise(number).alias("found"),
        )

    start = F.struct(F.lit(False).alias("skip"), F.lit(None).cast("int").alias("found"))
    by_args = F.aggregate(tokens, start, step)["found"]
    is_gh = c.rlike("(?<!\\w)gh(?!\\w)")
    return F.when((url != "") & is_gh, url.cast("int")).when(args != "", by_args)


def _drop_worktree(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "/+\\z", ""), "/\\.claude/worktrees/[^/]+\\z", "")


@bound
def module_of(file_path: Column | str, cwd: Column | str | None = None, home: str = "") -> Column:
    """Folder of an edited file relative to its repository, null when there is none."""
    raw = js_trim(file_path)
    c = _drop_worktree(F.coalesce(col(cwd), F.lit(""))) if cwd is not None else F.lit("")

    def relative(p: Column, stripped: Column) -> Column:
        in_cwd = (c != "") & F.startswith(p, F.concat(c, F.lit("/")))
        rel = F.when(stripped != p, stripped).when(in_cwd, F.substr(p, F.length(c) + 2))
        if home:
            tail = F.substring(p, len(home) + 2, 2_147_483_647)
            rel = rel.when(F.startswith(p, F.lit(home + "/")), F.concat(F.lit("~/"), tail))
        return rel.otherwise(F.regexp_replace(p, "^/", ""))

    def folder(rel: Column) -> Column:
        segs = F.filter(F.split(rel, "/"), lambda s: ~s.isin("", ".", ".."))
        dirs = let(segs, lambda x: F.slice(x, F.lit(1), F.greatest(F.size(x) - 1, F.lit(0))))
        kept = F.regexp_replace(F.array_join(dirs, "/"), "(?:(?:^|/)(?:" + "|".join(MODULE_TAIL) + "))+\\z", "")
        return F.nullif(kept, F.lit(""))

    in_tree = "^(?:.*?/)?\\.claude/worktrees/[^/]+/"
    rel = let(
        F.replace(raw, F.lit("\\"), F.lit("/")),
        lambda p: let(F.regexp_replace(p, in_tree, ""), lambda stripped: relative(p, stripped)),
    )
    return F.when((raw != "") & ~F.contains(raw, F.lit("\n")), folder(rel))


@bound
def short_module(module: Column | str) -> Column:
    segs = F.split(col(module), "/")
    kept = F.filter(segs, lambda s: ~s.isin(MODULE_SKIP))
    use = F.when(F.size(kept) > 0, kept).otherwise(segs)
    return F.array_join(F.slice(use, -F.least(F.lit(2), F.size(use)), F.lit(2)), "/")


@bound
def project_of(cwd: Column | str, home: str = "") -> Column:
    """Last folder of the working directory; the home folder is ``~``."""
    c = _drop_worktree(F.coalesce(col(cwd), F.lit("")))
    return F.when((c == "") | (c == home), F.lit("~")).otherwise(
        F.coalesce(F.nullif(F.substring_index(c, "/", -1), F.lit("")), F.lit("~"))
    )


def lower_tr(c: Column | str) -> Column:
    """Lower case with the dotted and dotless i of Turkish."""
    return F.lower(F.translate(col(c), "İI", "iı"))


def title_words(title: Column | str) -> Column:
    return F.split(lower_tr(title), "\\P{L}+")  # white space is no letter


def is_title_word(w: Column) -> Column:
    return (F.length(w) >= 3) & ~w.isin(TITLE_STOP) & w.rlike("[aeıioöuüy]")


def is_subject(stem: Column) -> Column:
    return ~stem.isin(DEV_STEMS) & ~stem.isin(GENERIC_STEMS)


def word_stems(words: Column) -> Column:
    """Distinct five-letter stems of those of the words that count in a title, in order."""
    return F.array_distinct(F.transform(F.filter(F.array_distinct(words), is_title_word), lambda w: F.substring(w, 1, STEM)))


def title_tokens(title: Column | str) -> Column:
    """Distinct five-letter stems of the title's words, in order."""
    return word_stems(title_words(title))


def subject_tokens(title: Column | str) -> Column:
    """Title tokens without development and greeting words."""
    return F.filter(title_tokens(title), is_subject)


@bound
def informative_title(title: Column | str) -> Column:
    t = js_trim(col(title))
    words = F.filter(title_tokens(t), lambda x: ~x.isin(GENERIC_STEMS))
    return (t != "") & ~t.rlike("^[0-9a-fA-F]{6,}\\z") & ~t.rlike("^[<#]") & (F.size(words) >= 2)


def clean_title(title: Column | str, keys: list[Column] | None = None) -> Column:
    """A title without its key and leading or trailing punctuation, at most 90 characters."""
    t = F.regexp_replace(col(title), f"^(?i:/goal)(?!\\w){WS}*", "")
    t = js_trim(F.regexp_replace(t, f"{WS}+", " "))
    for k in keys or []:
        t = F.replace(t, F.coalesce(k, F.lit("")), F.lit(" "))  # an empty key leaves the text as it is
    t = F.ltrim(t, F.lit(WS_SIGNS + ":–—-·|,.()[]"))
    t = F.rtrim(t, F.lit(WS_SIGNS + ":–—-·|,.(["))
    if keys:  # else no two white space characters are left side by side
        t = F.regexp_replace(t, f"{WS}+", " ")
    return let(t, lambda x: F.when(F.length(x) > 90, F.concat(F.substring(x, 1, 89), F.lit("…"))).otherwise(x))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Overlap of two token arrays read as sets; 0 when either is empty."""
    a, b = F.array_distinct(col(a)), F.array_distinct(col(b))
    inter = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - inter
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(inter / union)

