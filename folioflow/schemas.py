"""Explicit Spark schemas of the engine's datasets: what its scans and sinks read and write."""

ANNOUNCEMENT = "secCode string, secName string, announcementTitle string, announcementTime long, adjunctUrl string, announcementId string"
MANIFEST_ITEM = "idx int, code string, name string, title string, date string, url string, file string, size long"
MANIFEST = "count int, items array<struct<idx:int,code:string,name:string,title:string,date:string,url:string,file:string,size:bigint>>"
PAGE = "doc_id string, page_no int, text string"
TABLE = "doc_id string, page_no int, table_no int, page_text string, rows array<array<string>>"
CHUNK = "source string, chunk_id int, text string, is_table boolean"
QA = "instruction string, output string, source string, company string"
SHAREGPT = "conversations array<struct<role:string,content:string>>, source string, company string"
RECORD = "rec_id long, company string, file string, chunk_idx int, text string"
HIT = "qid long, rec_id long, score double, vec_rank int, bm25_rank int, rank int"
REFUSAL = "id int, type string, company string, question string, note string"
PAIRED = "idx int, company string, question string, output string, source string, orig_judge int, rewritten string, company_kept boolean"
STORED_ANSWER = "instruction string, ft_answer string"
