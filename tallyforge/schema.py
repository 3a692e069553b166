"""Schemas of the parsed representation and of results."""

from __future__ import annotations

NODE = "struct<node_id:int,parent_id:int,kind:string,label:string,first_line:int,last_line:int,start_off:int,end_off:int,owner_fn:int,enclosing_fns:array<int>,level:int,cog_level:int,is_continuation:boolean,parent_kind:string,parent_label:string,prev_kind:string,wraps_continuation:boolean,subtree_end:int>"
TOKEN = "struct<pos:int,kind:string,text:string,first_line:int,last_line:int,start_off:int,end_off:int,enclosing_fns:array<int>>"
FUNCTION = "struct<fn_id:int,name:string,params:array<struct<name:string>>,node_id:int,first_line:int,last_line:int,start_off:int,end_off:int,doc_lines:int,path_count:double>"
#: One row a file. status is 'ok' or 'error'; an error row has no nodes, tokens or functions.
PARSED = f"project string, path string, language string, status string, error string, content string, nodes array<{NODE}>, tokens array<{TOKEN}>, functions array<{FUNCTION}>"

#: The kinds of nodes and tokens.
NODE_KINDS = ["block", "statement", "expression", "declaration", "branch", "else", "loop", "case", "catch", "return", "jump", "call", "assignment", "binary", "logical", "conditional", "unary", "identifier", "literal", "import", "function", "other"]
TOKEN_KINDS = ["keyword", "identifier", "literal", "operator", "punctuation", "comment"]
