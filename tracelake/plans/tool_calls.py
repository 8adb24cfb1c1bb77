"""Tool calls of every layout as ``struct(tool, kind, target, dir, summary, detail)`` columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracelake.functions import json as J
from tracelake.functions.text import clip_line, let, literal_map, nz, one_line, safe_text, shell_argv, short_path, split_cd

# --- fixed values: tool names -> action kinds, per layout ------------------------------------------
KINDS = {
    "line_log": {
        "Bash": "bash", "BashOutput": "bash", "KillShell": "bash", "PowerShell": "bash",
        "Edit": "edit", "MultiEdit": "edit", "NotebookEdit": "edit", "Write": "write",
        "Read": "read", "NotebookRead": "read",
        "Grep": "search", "Glob": "search", "ToolSearch": "search", "LS": "read",
        "Agent": "agent", "Task": "agent", "WebFetch": "web", "WebSearch": "web",
        "TodoWrite": "todo", "TaskCreate": "todo", "TaskUpdate": "todo",
        "SendMessage": "message", "Skill": "skill",
    },
    "rollout": {
        "view_image": "read", "read_file": "read", "list_dir": "read", "grep_files": "search",
        "web_search": "web", "web__run": "web", "update_plan": "todo", "create_goal": "todo",
        "update_goal": "todo", "get_goal": "todo", "spawn_agent": "agent", "send_message": "message",
        "followup_task": "message", "send_input": "message", "send_message_to_thread": "message",
        "request_user_input_async": "message",
    },
    "part_store": {
        "bash": "bash", "shell": "bash", "edit": "edit", "patch": "edit", "multiedit": "edit",
        "apply_patch": "edit", "write": "write", "read": "read", "list": "read", "grep": "search",
        "glob": "search", "codesearch": "search", "webfetch": "web", "websearch": "web", "task": "agent",
        "todowrite": "todo", "todoread": "todo", "skill": "skill", "question": "message",
    },
    "document": {
        "run_shell_command": "bash", "replace": "edit", "write_file": "write", "read_file": "read",
        "read_many_files": "read", "glob": "search", "search_file_content": "search",
        "list_directory": "search", "google_web_search": "web", "web_fetch": "web", "write_todos": "todo",
    },
    "chain_store": {
        "shell_command": "bash", "read_file_lines": "read", "list_dir": "read",
        "open_file_in_side_editor": "read", "search_file_line": "search", "find_files": "search",
        "edit_file_tool": "edit", "replace_file": "write", "create_folder": "write", "move": "edit",
        "web_search": "web", "web_extract": "web", "open_url_in_app_browser": "web",
        "agentic_find": "agent", "run_python": "other", "bionic_tool": "mcp",
    },
}
#: The input field that says what a line-log call is about.
SUMMARY_KEYS = {
    "Bash": "command", "Read": "file_path", "Write": "file_path", "Edit": "file_path", "MultiEdit": "file_path",
    "NotebookEdit": "notebook_path", "Glob": "pattern", "Grep": "pattern", "WebFetch": "url", "WebSearch": "query",
    "Agent": "description", "Task": "description", "SendMessage": "message", "ToolSearch": "query", "Skill": "skill",
}
#: Input fields worth showing per line-log tool.
DETAIL_FIELDS = {
    "Bash": ["command", "description", "run_in_background"],
    "Edit": ["file_path", "old_string", "new_string", "replace_all"],
    "Write": ["file_path", "content"],
    "Read": ["file_path", "offset", "limit"],
    "NotebookEdit": ["notebook_path", "new_source"],
    "Grep": ["pattern", "path", "glob", "type", "output_mode"],
    "Glob": ["pattern", "path"],
    "Agent": ["description", "subagent_type", "model", "prompt", "run_in_background", "isolation"],
    "Task": ["description", "subagent_type", "model", "prompt", "run_in_background"],
    "WebFetch": ["url", "prompt"],
    "WebSearch": ["query"],
    "Skill": ["skill", "args"],
    "SendMessage": ["to", "message"],
}
SHELL_TOOLS = ("shell", "exec_command", "shell_command", "local_shell", "container.exec")
# --- end of fixed values ----------------------------------------------------------------------------


def tool_kinds(spark: SparkSession) -> DataFrame:
    """The (layout, tool, kind) mapping as a small dimension table."""
    rows = [(layout, tool, kind) for layout, m in KINDS.items() for tool, kind in m.items()]
    return spark.createDataFrame(rows, "layout string, tool string, kind string")


def classify_action(layout: str, tool: Column) -> Column:
    """The kind of a tool call by its name; integrations are told by prefix or underscore."""
    known = literal_map(KINDS[layout])
    hit = lambda name: F.try_element_at(known, name)
    if layout == "rollout":
        base = F.element_at(F.split(tool, "\\.|__"), -1)
        return F.when(F.startswith(tool, F.lit("mcp__")), F.lit("mcp")).otherwise(F.coalesce(hit(tool), hit(base), F.lit("other")))
    if layout == "part_store":
        return F.coalesce(hit(F.lower(tool)), F.when(F.contains(tool, F.lit("_")), F.lit("mcp")), F.lit("other"))
    if layout == "document":
        mcp = F.startswith(tool, F.lit("mcp_")) | F.contains(tool, F.lit("__"))
        return F.coalesce(hit(tool), F.when(mcp, F.lit("mcp")), F.lit("other"))
    mcp = F.startswith(tool, F.lit("mcp__")) if layout == "line_log" else F.lit(False)
    return F.coalesce(hit(tool), F.when(mcp, F.lit("mcp")), F.lit("other"))


def _detail(fields: list[tuple[str, Column]]) -> Column:
    """The fields that have a value, as an array of (key, value) structs."""
    return F.filter(
        F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in fields]),
        lambda e: e["value"].isNotNull(),
    )


def _finish(raw: Column) -> Column:
    """Mask the chosen texts of a raw call, once, whatever branch they come from; nothing is cut."""
    fields = F.transform(raw["detail"], lambda e: F.struct(e["key"].alias("key"), safe_text(e["value"]).alias("value")))
    return F.struct(
        raw["tool"].alias("tool"),
        raw["kind"].alias("kind"),
        clip_line(raw["target"]).alias("target"),
        nz(clip_line(raw["dir"])).alias("dir"),
        clip_line(raw["summary"]).alias("summary"),
        F.when(F.size(fields) > 0, F.map_from_entries(fields)).alias("detail"),
    )


def _raw(tool: Column, kind: Column, target: Column, dir_: Column | None, summary: Column, detail: Column | None) -> Column:
    text = lambda c: (F.lit(None) if c is None else c).cast("string")
    return F.struct(
        text(tool).alias("tool"),
        text(kind).alias("kind"),
        text(target).alias("target"),
        text(dir_).alias("dir"),
        text(summary).alias("summary"),
        (F.lit(None) if detail is None else detail).cast("array<struct<key:string,value:string>>").alias("detail"),
    )


def _mcp(tool: Column, arg: Column) -> Column:
    part = F.split(tool, "__")
    at = lambda i: F.coalesce(F.try_element_at(part, F.lit(i)), F.lit(""))
    return F.concat(at(2), F.lit(" · "), at(3), F.coalesce(F.concat(F.lit(": "), nz(arg)), F.lit("")))


def tool_summary_text(tool: Column, input_text: Column, m: Column) -> Column:
    """The meaningful field of a line-log call, else its first text, else its JSON; text inputs as they are."""
    keyed = J.any_text(m, F.coalesce(F.try_element_at(literal_map(SUMMARY_KEYS), tool), F.lit("")))
    picked = F.when(m.isNotNull(), F.coalesce(keyed, J.first_text(m), input_text)).otherwise(
        F.when(~F.coalesce(input_text, F.lit("")).rlike("^[\\[{]"), input_text)
    )
    return F.coalesce(picked, F.lit(""))


def tool_summary(tool: Column, input_text: Column, limit: int | None = None) -> Column:
    return let(J.obj(input_text), lambda m: safe_text(one_line(tool_summary_text(tool, input_text, m)), limit))


def _line_log_fields(tool: Column, m: Column) -> Column:
    """The fields of a tool from the (tool, field) table; a multi-edit shows its first edit and their number."""
    table = F.create_map(
        *[
            x
            for name, fields in DETAIL_FIELDS.items()
            for x in (F.lit(name), F.array(*[F.lit(k) for k in fields]))
        ]
    )
    rows = F.transform(
        F.try_element_at(table, tool),
        lambda f: F.struct(f.alias("key"), J.any_text(m, f).alias("value")),
    )
    edits = F.filter(F.from_json(J.json_text(m, "edits"), "array<string>"), lambda e: F.startswith(e, F.lit("{")))
    multi = let(
        edits,
        lambda e: _detail(
            [
                ("file_path", J.text(m, "file_path")),
                ("edits", F.coalesce(F.size(e), F.lit(0)).cast("string")),
                ("old_string", nz(F.get_json_object(F.try_element_at(e, F.lit(1)), "$.old_string"))),
                ("new_string", nz(F.get_json_object(F.try_element_at(e, F.lit(1)), "$.new_string"))),
            ]
        ),
    )
    return F.when(tool == "MultiEdit", multi).otherwise(F.filter(rows, lambda r: r["value"].isNotNull()))


def line_log_call(tool: Column, input_text: Column, detail: bool = True) -> Column:
    def build(m: Column, kind: Column, sp: Column, said: Column) -> Column:
        path = J.text(m, "file_path", "notebook_path", "path")
        where = J.text(m, "path", "glob")
        pattern = F.coalesce(J.text(m, "pattern", "query"), F.lit(""))
        target = (
            F.when(kind.isin("edit", "write", "read"), F.coalesce(short_path(path), said))
            .when(kind == "search", F.concat(pattern, F.coalesce(F.concat(F.lit(" · "), short_path(where, 2)), F.lit(""))))
            .when(kind == "mcp", _mcp(tool, said))
            .when(kind == "bash", F.coalesce(sp["rest"], said))
            .otherwise(said)
        )
        dir_ = F.when(kind == "bash", sp["dir"])
        return _raw(tool, kind, target, dir_, said, _line_log_fields(tool, m) if detail else None)

    call = let(
        J.obj(input_text),
        lambda m: let(
            classify_action("line_log", tool),
            lambda kind: let(
                split_cd(J.text(m, "command")),
                lambda sp: let(tool_summary_text(tool, input_text, m), lambda said: build(m, kind, sp, said)),
            ),
        ),
    )
    # the summary of a call is not folded into one line a second time
    done = let(call, _finish)
    return let(
        done,
        lambda c: F.struct(
            *[c[f].alias(f) for f in ("tool", "kind", "target", "dir")],
            tool_summary(tool, input_text).alias("summary"),
            c["detail"].alias("detail"),
        ),
    )


# ------------------------------------------------------------------------------------------------ rollouts
_FILE = "(?<![^\\n])\\*\\*\\* (?:Update|Add|Delete) File: ([^\\n\\r]+)"
# fixed values: a string literal of the script language, without interpolation
_LITERAL = "(\"(?:[^\"\\\\]|\\\\[\\s\\S])*\"|'(?:[^'\\\\]|\\\\[\\s\\S])*'|`(?:[^`\\\\$]|\\$(?!\\{)|\\\\[\\s\\S])*`)"


def unescape_literal(c: Column) -> Column:
    """The value of a quoted script literal.  Doubled backslashes are held back while the others are decoded."""
    body = F.substring(c, 2, 2_147_483_647)
    body = F.left(body, F.greatest(F.length(body) - 1, F.lit(0)))
    hold = ""
    out = F.replace(body, F.lit("\\\\"), F.lit(hold))
    codes = F.regexp_extract_all(out, F.lit("\\\\u([0-9a-fA-F]{4})"), F.lit(1))
    chars = F.transform(codes, lambda h: F.decode(F.unhex(h), "UTF-16BE"))
    pieces = F.split(out, "\\\\u[0-9a-fA-F]{4}", -1)
    joined = F.array_join(F.zip_with(pieces, chars, lambda p, x: F.concat(p, F.coalesce(x, F.lit("")))), "")
    out = F.when(F.size(codes) > 0, joined).otherwise(out)
    for esc, char in (("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r")):
        out = F.replace(out, F.lit(esc), F.lit(char))
    return F.replace(F.regexp_replace(out, "\\\\([\\s\\S])", "$1"), F.lit(hold), F.lit("\\"))


def find_patch(src: Column) -> Column:
    """A patch body in a call input: the text itself or the string literal that holds it."""
    lit_ = F.regexp_extract_all(src, F.lit(_LITERAL), F.lit(1))
    hits = F.filter(F.transform(lit_, unescape_literal), lambda v: F.contains(v, F.lit("*** Begin Patch")))
    trimmed = F.ltrim(F.regexp_replace(src, "^\\s+", ""))
    return F.when(F.startswith(trimmed, F.lit("*** Begin Patch")), trimmed).when(
        F.contains(src, F.lit("*** Begin Patch")), F.try_element_at(hits, F.lit(1))
    )


def _patch_call(tool: Column, patch: Column) -> Column:
    def build(files: Column) -> Column:
        names = F.transform(F.slice(files, 1, 3), lambda p: F.coalesce(nz(F.substring_index(p, "/", -1)), p))
        first = F.try_element_at(files, F.lit(1))
        extra = F.when(F.size(files) > 3, F.concat(F.lit(" +"), (F.size(files) - 3).cast("string"))).otherwise(F.lit(""))
        listed = F.when(F.size(files) == 1, short_path(first)).otherwise(F.concat(F.array_join(names, ", "), extra))
        target = F.coalesce(nz(listed), F.lit("patch"))
        count = F.when(F.size(files) > 1, F.size(files).cast("string"))
        detail = _detail([("patch", patch), ("file_path", first), ("files", count)])
        return _raw(tool, F.lit("edit"), target, None, target, detail)

    return let(F.transform(F.regexp_extract_all(patch, F.lit(_FILE), F.lit(1)), lambda p: F.trim(p)), build)


def _shell_call(tool: Column, cmd: Column, workdir: Column, more: Column | None = None, whole: Column | None = None) -> Column:
    def build(sp: Column) -> Column:
        target = sp["rest"]
        if more is not None:
            note = F.concat(F.lit(" (+"), more.cast("string"), F.lit(" commands)"))
            target = F.when(more > 0, F.concat(clip_line(target), note)).otherwise(target)
        detail = _detail([("command", whole if whole is not None else cmd), ("workdir", workdir)])
        return _raw(tool, F.lit("bash"), target, F.coalesce(sp["dir"], workdir), cmd, detail)

    return let(split_cd(cmd), build)


def _named_call(tool: Column, m: Column) -> Column:
    def build(kind: Column, base: Column) -> Column:
        arg = F.coalesce(J.text(m, "title", "query"), J.first_text(m, ("message", "code")))
        seconds = F.round(F.coalesce(J.number(m, "duration_ms"), F.lit(0.0)) / 1000).cast("bigint").cast("string")
        target = F.coalesce(
            F.when(kind == "agent", J.text(m, "task_name", "agent_nickname", "name"))
            .when(kind == "message", F.concat(F.lit("→ "), J.text(m, "target")))
            .when(base.isin("wait_agent", "wait"), F.lit("waiting for sub-agents"))
            .when(base == "sleep", F.concat(F.lit("waiting "), seconds, F.lit(" s")))
            .when(base == "list_agents", F.lit("listing agents"))
            .when(kind == "read", short_path(J.text(m, "path", "file_path")))
            .when(kind == "web", J.text(m, "query", "q", "url"))
            .when(kind == "mcp", _mcp(tool, arg))
            .otherwise(F.coalesce(J.text(m, "title"), J.first_text(m, ("message",)))),
            F.lit(""),
        )
        detail = _detail([("code", J.text(m, "code"))])
        return let(target, lambda t: _raw(tool, kind, F.coalesce(nz(t), tool), None, t, detail))

    base = F.element_at(F.split(tool, "\\.|__"), -1)
    return let(classify_action("rollout", tool), lambda kind: let(base, lambda b: build(kind, b)))


def _script_field(src: Column, key: str) -> Column:
    return F.transform(F.regexp_extract_all(src, F.lit(f"[\"']?{key}[\"']?\\s*:\\s*{_LITERAL}"), F.lit(1)), unescape_literal)


def script_call(src: Column) -> Column:
    """The first meaningful call inside a tool script: a patch, else its shell commands, else a named call."""
    names = F.regexp_extract_all(src, F.lit("tools\\.([A-Za-z_]\\w*)\\s*\\("), F.lit(1))
    shell = F.regexp_extract_all(
        src,
        F.lit("tools\\.(?:exec_command|shell|shell_command)\\s*\\([\\s\\S]*?[\"']?(?:cmd|command)[\"']?\\s*:\\s*" + _LITERAL),
        F.lit(1),
    )
    workdir = F.try_element_at(_script_field(src, "workdir"), F.lit(1))
    none = F.from_json(F.lit("{}"), "map<string,variant>")

    def build(patch: Column, cmds: Column, name: Column) -> Column:
        code = _detail([("code", src)])
        stdin = name == "write_stdin"

        def generic(n: Column) -> Column:
            kind = F.when(stdin, F.lit("bash")).otherwise(n["kind"])
            target = F.when(stdin, F.lit("sending input to the running command")).otherwise(n["target"])
            return _raw(n["tool"], kind, target, None, n["summary"], code)

        shell_call = _shell_call(
            F.lit("exec_command"), F.try_element_at(cmds, F.lit(1)), workdir, F.size(cmds) - 1, F.array_join(cmds, "\n")
        )
        return (
            F.when(patch.isNotNull(), _patch_call(F.lit("apply_patch"), patch))
            .when(F.size(cmds) > 0, shell_call)
            .when(name.isNotNull(), let(_named_call(name, none), generic))
            .otherwise(_raw(F.lit("exec"), F.lit("other"), src, None, src, code))
        )

    picked = lambda n: F.coalesce(F.try_element_at(F.filter(n, lambda x: x != "exec_command"), F.lit(1)), F.try_element_at(n, F.lit(1)))
    return let(
        find_patch(src),
        lambda patch: let(
            F.filter(F.transform(shell, unescape_literal), lambda x: x != ""),
            lambda cmds: let(let(names, picked), lambda name: build(patch, cmds, name)),
        ),
    )


def rollout_call(ptype: Column, name: Column, namespace: Column, args_text: Column, input_text: Column) -> Column:
    """``custom_tool_call`` takes ``input_text``; ``function_call`` takes ``args_text`` (JSON or plain)."""
    name = F.coalesce(nz(name), F.lit("tool"))
    wrap = lambda c: F.from_json(F.to_json(F.struct(c.alias("input"))), "map<string,variant>")
    inp = F.coalesce(input_text, F.lit(""))
    args = F.when(ptype == "custom_tool_call", wrap(inp)).otherwise(
        F.coalesce(J.obj(args_text), F.when(args_text.isNotNull(), wrap(args_text)))
    )
    spaced = F.when(
        (ptype == "function_call") & nz(namespace).isNotNull() & ~F.startswith(name, F.lit("mcp__")),
        F.concat(namespace, F.when(F.startswith(namespace, F.lit("mcp__")), F.lit("__")).otherwise(F.lit(".")), name),
    ).otherwise(name)

    def build(m: Column) -> Column:
        def argv(key: str) -> Column:
            return F.coalesce(J.text(m, key), let(J.texts(m, key), lambda a: F.when(F.size(a) > 0, shell_argv(a))))

        body = F.when(ptype == "custom_tool_call", inp).otherwise(F.coalesce(J.text(m, "input", "patch"), F.lit("")))
        patch = _patch_call(F.lit("apply_patch"), let(body, lambda b: F.coalesce(find_patch(b), b)))
        named = let(spaced, lambda t: _named_call(t, m))
        return let(
            nz(F.coalesce(argv("cmd"), argv("command"))),
            lambda cmd: F.when(name == "apply_patch", patch)
            .when((ptype == "custom_tool_call") & (name == "exec"), let(inp, script_call))
            .when(
                (ptype == "function_call") & name.isin(*SHELL_TOOLS) & cmd.isNotNull(),
                _shell_call(name, cmd, J.text(m, "workdir", "cwd")),
            )
            .otherwise(named),
        )

    return F.when(ptype.isin("custom_tool_call", "function_call"), let(let(args, build), _finish))


# ------------------------------------------------------------------------------------------------ part store
def part_call(tool: Column, input_text: Column) -> Column:
    def build(m: Column, kind: Column, sp: Column) -> Column:
        path = J.text(m, "filePath", "file_path", "path")
        workdir = J.text(m, "workdir", "cwd")
        cmd = J.text(m, "command", "cmd")
        pattern = J.text(m, "pattern", "query")
        url = J.text(m, "url", "query")
        task = J.text(m, "description", "prompt")
        desc = J.text(m, "description")
        target = F.coalesce(
            F.when(kind == "bash", sp["rest"])
            .when(kind.isin("edit", "write", "read"), short_path(clip_line(path)))
            .when(kind == "search", F.coalesce(pattern, path))
            .when(kind == "web", url)
            .when(kind == "agent", task)
            .when(kind == "skill", J.text(m, "name", "skill"))
            .otherwise(J.first_text(m)),
            F.lit(""),
        )
        file_ = ("file_path", path)
        web_key = J.any_text(m, "url").isNotNull()
        fields = (
            F.when(kind == "bash", _detail([("command", cmd), ("description", desc), ("workdir", workdir)]))
            .when(
                kind == "edit",
                _detail(
                    [
                        file_,
                        ("old_string", J.text(m, "oldString", "old_string")),
                        ("new_string", J.text(m, "newString", "new_string")),
                        ("patch", J.text(m, "patchText", "patch")),
                    ]
                ),
            )
            .when(kind == "write", _detail([file_, ("content", J.text(m, "content"))]))
            .when(kind == "read", _detail([file_]))
            .when(kind == "search", _detail([("pattern", pattern), ("path", path)]))
            .when(kind == "web", _detail([("url", F.when(web_key, url)), ("query", F.when(~web_key, url))]))
            .when(
                kind == "agent",
                _detail([("subagent_type", J.text(m, "subagent_type")), ("description", task), ("prompt", J.text(m, "prompt"))]),
            )
        )
        dir_ = F.when(kind == "bash", F.coalesce(sp["dir"], workdir))

        def raw(t: Column) -> Column:
            said = F.when(kind == "bash", F.coalesce(cmd, desc, tool)).otherwise(F.coalesce(nz(t), tool))
            return _raw(tool, kind, t, dir_, said, fields)

        return let(target, raw)

    call = let(
        J.obj(input_text),
        lambda m: let(
            classify_action("part_store", tool),
            lambda kind: let(split_cd(F.coalesce(J.text(m, "command", "cmd"), F.lit(""))), lambda sp: build(m, kind, sp)),
        ),
    )
    return let(call, _finish)


# ------------------------------------------------------------------------------------------------ documents
def document_call(tool: Column, args_text: Column) -> Column:
    def build(m: Column, sp: Column) -> Column:
        path = J.text(m, "file_path", "absolute_path", "path")
        folder = J.text(m, "dir_path", "path")
        listed = lambda k: nz(F.array_join(J.texts(m, k), ", "))
        include = F.coalesce(J.text(m, "include"), listed("include"), J.text(m, "paths"), listed("paths"))
        is_shell = tool == "run_shell_command"
        is_file = tool.isin("replace", "write_file", "read_file")
        is_find = tool.isin("glob", "search_file_content")
        target = F.coalesce(
            F.when(is_shell, sp["rest"])
            .when(is_file, short_path(path))
            .when(tool == "read_many_files", include)
            .when(is_find, J.text(m, "pattern"))
            .when(tool == "list_directory", short_path(folder))
            .when(tool == "google_web_search", J.text(m, "query"))
            .when(tool == "web_fetch", J.text(m, "prompt", "url"))
            .otherwise(J.text(m, "description", "query", "prompt", "command", "file_path", "path")),
            F.lit(""),
        )
        fields = (
            F.when(is_shell, _detail([("command", J.text(m, "command")), ("description", J.text(m, "description"))]))
            .when(is_file, _detail([("file_path", path)]))
            .when(is_find, _detail([("pattern", J.text(m, "pattern")), ("path", folder)]))
        )
        dir_ = F.when(is_shell, F.coalesce(sp["dir"], J.text(m, "dir_path", "directory")))
        kind = classify_action("document", tool)
        return let(target, lambda t: _raw(tool, kind, t, dir_, t, fields))

    call = let(
        J.obj(args_text),
        lambda m: let(split_cd(F.coalesce(J.text(m, "command"), F.lit(""))), lambda sp: build(m, sp)),
    )
    return let(call, _finish)


# ------------------------------------------------------------------------------------------------ chain store
def chain_call(tool: Column, args_text: Column) -> Column:
    tool = F.coalesce(nz(tool), F.lit("tool"))

    def build(m: Column, kind: Column, sp: Column) -> Column:
        path = J.text(m, "path")
        workdir = J.text(m, "workdir")
        first_of = lambda k: F.coalesce(J.text(m, k), F.try_element_at(J.texts(m, k), F.lit(1)))
        side = lambda k: F.coalesce(short_path(J.text(m, k)), F.lit(""))
        needle = F.when(tool == "search_file_line", J.text(m, "search_term")).otherwise(J.text(m, "glob"))
        is_shell = tool == "shell_command"
        target = F.coalesce(
            F.when(is_shell, sp["rest"])
            .when(kind == "search", needle)
            .when(tool == "move", F.concat(side("old_path"), F.lit(" → "), side("new_path")))
            .when(tool == "web_search", F.coalesce(first_of("objective"), first_of("searchQueries")))
            .when(tool == "web_extract", F.coalesce(first_of("urls"), first_of("objective")))
            .when(tool == "open_url_in_app_browser", J.text(m, "url"))
            .when(tool == "agentic_find", first_of("queries"))
            .when(tool == "run_python", F.lit("running Python"))
            .when(tool == "bionic_tool", J.text(m, "name"))
            .when(kind.isin("read", "edit", "write"), short_path(path))
            .otherwise(J.first_text(m)),
            F.lit(""),
        )
        fields = (
            F.when(is_shell, _detail([("command", J.text(m, "command")), ("workdir", workdir)]))
            .when(kind == "search", _detail([("pattern", needle), ("path", path)]))
            .when(tool == "run_python", _detail([("code", J.text(m, "code"))]))
            .when((tool != "move") & kind.isin("read", "edit", "write"), _detail([("file_path", path)]))
        )
        dir_ = F.when(is_shell, F.coalesce(sp["dir"], workdir))
        return let(target, lambda t: _raw(tool, kind, F.coalesce(nz(t), tool), dir_, t, fields))

    call = let(
        J.obj(args_text),
        lambda m: let(
            classify_action("chain_store", tool),
            lambda kind: let(split_cd(F.coalesce(J.text(m, "command"), F.lit(""))), lambda sp: build(m, kind, sp)),
        ),
    )
    return let(call, _finish)
