"""Row types of the graph tables, and the classes of edge kinds that the queries use."""

from __future__ import annotations

# Kinds of nodes and edges, in protocol order.
NODE_KINDS = (
    "file package namespace module function class interface type enum variable method property parameter field "
    "constructor external_symbol"
).split()
EDGE_KINDS = (
    "contains exports imports calls accesses instantiates type_ref extends implements overrides dispatches decorates "
    "renders tests references"
).split()
STRUCTURAL = ["contains", "exports", "imports"]
EXECUTION = ["calls", "instantiates", "accesses", "renders"]
INVOKE = ["calls", "instantiates", "renders"]
TYPE_FOCUS = ["type_ref", "extends", "implements", "overrides", "decorates"]
DISPATCH_SOURCE = ["overrides", "implements"]
HERITAGE = ["extends", "implements", "overrides"]
#: The kinds of node that a query may seed from or report as declarations.
PUBLIC_KINDS = ["class", "interface", "function", "type", "enum"]
CONTAINERS = ["class", "interface", "namespace", "module", "enum", "file"]

#: Schemas as text, which needs no session to import.
SPAN = "struct<file:string,startLine:int,startCol:int,endLine:int,endCol:int>"
NODE = (
    "struct<id:string,kind:string,language:string,name:string,qualifiedName:string,file:string,external:boolean,"
    "ignored:boolean,exported:boolean,closure:boolean,modifiers:array<string>,literals:array<string>,"
    "enumMembers:array<struct<name:string,value:string>>,"
    "objectMembers:array<struct<name:string,kind:string,line:int,signature:string>>,"
    "decorators:array<struct<name:string,arguments:array<struct<literal:string>>>>,signature:string,"
    f"evidence:{SPAN},implementation:{SPAN}>"
)
EDGE = f"struct<`from`:string,`to`:string,kind:string,evidence:{SPAN}>"
DUMP = (
    "project string, languages array<string>, indexer string, generation struct<input:string>, "
    f"nodes array<{NODE}>, edges array<{EDGE}>, "
    "coverage array<struct<provider:string,language:string,target:string,family:string,state:string>>, "
    f"unresolved array<struct<provider:string,language:string,target:string,universe:string,family:string,reason:string,evidence:{SPAN}>>, "
    "diagnostics array<struct<file:string,line:int,column:int,code:string,message:string,severity:string>>, "
    "warnings array<string>"
)
