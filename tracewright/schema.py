"""Declared schemas of the run table and its nested columns."""

from __future__ import annotations

RUN_FIELDS = ["goal", "agents", "shared_state", "messages", "artifacts", "topology"]
TARGET_FIELDS = ["label", "success", "fault_turn"]
OBSERVABLE = ["goal", "agents", "messages", "artifacts", "shared_state", "topology"]

RUN_CSV = "run_id string, goal string, agents string, shared_state string, messages string, artifacts string, topology string"
TRAIN_CSV = RUN_CSV + ", label string, success int, fault_turn int"

NESTED = {
    "agents": "array<struct<id:string,role:string,tools:array<string>>>",
    "topology": "struct<type:string,edges:array<array<string>>>",
    "messages": "array<struct<t:bigint,`from`:string,`to`:string,type:string,intent:string,text:string,tool:string,"
                "refs:array<string>>>",
    "artifacts": "array<struct<id:string,`by`:string,t:bigint,type:string,subtask:string,hash:string,status:string>>",
    "shared_state": "array<struct<t:bigint,agent:string,key:string,op:string,value:string>>",
}
