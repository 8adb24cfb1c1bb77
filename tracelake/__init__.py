"""Fleet-scale analytics over coding-agent session logs, on Spark."""
