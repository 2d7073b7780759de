"""Row types of the repository model. Order that matters is a column (ordinal), ids are unique within a repository only."""

from __future__ import annotations

FILES = "repo_id string, id string, path string, language string, size long, content_hash string, line_count int, complexity int"
CONTENTS = "repo_id string, path string, content string"
SYMBOLS = "repo_id string, id string, file_id string, name string, kind string, exported boolean, start_line int, end_line int, ordinal long"
EDGES = "repo_id string, src string, dst string, kind string, location struct<file:string,line:int>, ordinal long"
FINDINGS = "repo_id string, rule string, severity string, message string, files array<string>, evidence array<string>, ordinal long"
EVENTS = "run_id string, seq long, node string, phase string, at string, duration_ms long, detail string"
RUNS = "id string, generated_at string, payload string"
CHECKPOINTS = "run_id string, seq long, updated_at string, state string"
NARRATION = "summary string, layering array<struct<layer:string,role:string>>, risks array<struct<title:string,severity:string,rationale:string,suggestion:string,relatedPaths:array<string>>>"

SYMBOL_KINDS = ("function", "class", "component", "interface", "type", "variable", "hook", "store")
RELATION_KINDS = ("import", "export", "call", "render", "type-reference", "extends", "implements", "uses-hook")
SEVERITIES = ("info", "warning", "error")
