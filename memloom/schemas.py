"""Schemas of the rows that pass between operators. Orders are columns, numbers of kinds are typed, `meta` is JSON."""

QA = "array<struct<question:string,answer:array<string>,evidence_doc_idx:array<int>,choices:array<string>,category:int>>"
MEMORY_QA = f"id string, source string, task_type string, memory_docs array<string>, qa {QA}, meta string"
POOL = "id string, source string, task_type string, split string, text string, label int, label_text string, meta string"
SAMPLE = "input_ids array<int>, loss_mask array<tinyint>, chunk_spans array<struct<s:int,e:int>>, qa_chunk_idx array<int>, chunk_limit int, token_limit int, id string, source string, task_type string, paradigm string"
GENERATION = "request struct<id:string>, output string, error string"
#: Kinds of tasks. Fixed values.
TASKS = ("AR", "CR", "TTL", "REC")
