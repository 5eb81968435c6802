"""Enumerations, confidences and table schemas of the code-graph model."""

from __future__ import annotations

DEF_KINDS = ("function", "method", "class", "interface", "module", "variable")
REF_KINDS = ("call", "new", "extends", "read")
RECEIVERS = ("bare", "self", "super", "other")
EDGE_KINDS = ("contains", "calls", "imports", "extends", "references")
PROVENANCES = ("scope", "import", "name", "cochange", "framework")
#: Base confidence of an edge by how it was found.
CONFIDENCE = {"scope": 100, "import": 95, "name": 80, "cochange": 55, "framework": 40}
#: Weight of the reason for which a node enters a context.
REASONS = {"seed": 1.0, "path": 1.0, "prose": 1.0, "on-path": 0.9, "caller": 0.6, "callee": 0.5, "co-change": 0.4}

FILES = "file_id int, path string, dir string, lang string, size long, mtime long, hash binary, had_error boolean"
DEFS = "file_id int, def_idx int, name string, kind string, start int, end int, name_start int, name_end int, parent int"
REFS = "file_id int, ref_idx int, name string, kind string, start int, end int, scope int, recv string, recv_name string"
IMPORTS = "file_id int, imp_idx int, module string"
ALIASES = "file_id int, local string, original string"
PROSE = "file_id int, scope int, word string"
NODES = "node_id int, node_key long, name string, kind string, file_id int, start int, end int"
EDGES = "src int, dst int, kind string, conf int, prov string"
COCHANGE = "a string, b string, conf int"
#: One file's extraction: a pure function of its bytes.
UNIT = (
    "path string, lang string, had_error boolean,"
    " defs array<struct<def_idx:int,name:string,kind:string,start:int,end:int,name_start:int,name_end:int,parent:int>>,"
    " refs array<struct<ref_idx:int,name:string,kind:string,start:int,end:int,scope:int,recv:string,recv_name:string>>,"
    " imports array<struct<imp_idx:int,module:string>>,"
    " aliases array<struct<local:string,original:string>>,"
    " prose array<struct<scope:int,word:string>>"
)
