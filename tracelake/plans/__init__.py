"""Layout plans: raw rows of a layout to neutral events, usage, nodes and sessions."""


def register_all() -> None:
    from tracelake.plans import chain_store, document, line_log, part_store, rollout
    from tracelake.sources.files import register_adapter

    register_adapter("line_log", lambda raw, **o: line_log.events(line_log.parse_lines(raw), **o))
    register_adapter("rollout", rollout.events)
    register_adapter("part_store", part_store.events)
    register_adapter("document", document.events)
    register_adapter("chain_store", chain_store.events)
