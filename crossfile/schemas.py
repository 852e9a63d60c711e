"""Fact tables (Spark DDL). One row a fact; ``ord`` is the order of reading, which decides ties."""

ARG = "struct<text:string,literal:boolean,value:string,boolean:boolean,name:string,attr_of:string,names:array<string>>"
CALL = f"struct<name:string,file:string,line:int,args:array<{ARG}>,keywords:array<struct<k:string,arg:{ARG}>>,spreads:boolean,dropped:boolean,in_tests:boolean>"
TABLES = {
    "modules": "module string, file string, lines int, ord long",
    "imports": "module string, target string, line int, ord long",
    "externals": "module string, target string, line int, ord long",
    "taken": "module string, target string, name string",
    "symbols": "sid string, module string, name string, kind string, doc string, line int, lines int, private boolean, owner string, ord long",
    "uses": "sid string, scope string",
    "call_edges": "caller string, callee string, lines array<int>",
    "calls": f"call_id long, name string, file string, line int, args array<{ARG}>, keywords array<struct<k:string,arg:{ARG}>>, spreads boolean, dropped boolean, in_tests boolean",
    "functions": "sid string, name string, params array<string>, positional array<string>, defaults array<struct<name:string,text:string>>, flags array<string>, decorated boolean, stub boolean, returns_value boolean, loads map<string,int>, relayed array<string>, "
    f"sole_call {CALL}, first_if struct<name:string,start:int,end:int>, shape string, receiver_reads map<string,int>, annotations map<string,string>, calls array<{CALL}>, ord long",
    "classes": "sid string, fields array<struct<name:string,type:string>>, bases array<string>, library_base boolean, decorated boolean, abstract boolean, ord long",
    "library_calls": "api string, module string, line int, raised_or_returned boolean, ord long",
    "names": "kind string, module string, name string",
    "name_counts": "scope string, name string, n long",
    "test_uses": "name string, file string, line int, start int, end int",
    "commit_files": "hash string, subject string, pos int, file string",
    "entrypoints": "sid string",
}
SITE = "struct<file:string,line:int,start:int,end:int>"
FINDING = f"id string, check string, symbol string, file string, line int, message string, fix string, related array<string>, key string, sites array<{SITE}>, commits array<struct<hash:string,subject:string>>"
SCORE = "key string, label string, value int, detail string, checks array<string>"
