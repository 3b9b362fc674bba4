"""Declared schemas of the stored tables and of the JSON columns."""

from pyspark.sql import types as T

DOCUMENT_STATUSES = ("PENDING", "PARSING", "INDEXING", "READY", "FAILED")
ELEMENT_TYPES = ("HEADING", "PARAGRAPH", "TABLE", "LIST", "CODE")
CHUNK_STRATEGIES = ("FIXED", "RECURSIVE", "STRUCTURE_AWARE")
QUESTION_TYPES = ("FACT", "MULTI_HOP", "TABLE", "NO_ANSWER")

ELEMENT = "struct<pos:int,type:string,text:string,level:int,page_no:int>"
ELEMENTS = f"array<{ELEMENT}>"

QUESTIONS_JSON = (
    "array<struct<type:string,stem:string,options:array<string>,answer:string,explanation:string,"
    "sourceChunkIds:array<bigint>>>"
)
GRADES_JSON = (
    "array<struct<index:int,type:string,correct:boolean,score:int,comment:string,missedSentences:array<string>>>"
)
ANSWERS_JSON = "array<string>"
RETRIEVED_JSON = (
    "array<struct<chunkId:bigint,file:string,section:string,page:int,snippet:string,tokenCount:int,"
    "vectorScore:double,ftsScore:double,rrfScore:double,rerankScore:double,vectorRank:int,ftsRank:int>>"
)
META_JSON = (
    "struct<vectorCount:int,ftsCount:int,fusedCount:int,rerankCount:int,vectorMs:bigint,ftsMs:bigint,"
    "fuseMs:bigint,rerankMs:bigint>"
)
VERDICT_JSON = "struct<faithful:boolean,citations:array<struct<no:int,supports:boolean>>>"
QUIZ_JSON = (
    "struct<questions:array<struct<type:string,stem:string,options:array<string>,answer:string,"
    "explanation:string,sourceNos:array<int>>>>"
)

CHUNKS = T.StructType([
    T.StructField("doc_id", T.LongType(), False),
    T.StructField("strategy", T.StringType(), False),
    T.StructField("chunk_index", T.IntegerType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("parent_index", T.IntegerType(), True),
    T.StructField("content", T.StringType(), False),
    T.StructField("token_count", T.IntegerType(), False),
    T.StructField("section_path", T.StringType(), True),
    T.StructField("page_no", T.IntegerType(), True),
    T.StructField("is_table", T.BooleanType(), False),
])

QUERY_LOG = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("kb_id", T.LongType(), False),
    T.StructField("visitor_id", T.StringType(), True),
    T.StructField("question", T.StringType(), False),
    T.StructField("retrieved", T.StringType(), True),
    T.StructField("chosen_ids", T.ArrayType(T.LongType()), True),
    T.StructField("answer", T.StringType(), True),
    T.StructField("latency_ms", T.LongType(), True),
    T.StructField("retrieval_meta", T.StringType(), True),
    T.StructField("created_at", T.TimestampType(), True),
])
