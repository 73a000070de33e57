"""Fixed schemas of the file formats."""

from __future__ import annotations

DOCUMENT = "id string, contents string, title string"
QUERY = "id string, text string"
QREL = "query_id string, doc_id string, relevance int"
TRIPLE = "qid string, pos_id string, neg_id string"
TRIPLE_CANDIDATES = "qid string, pos_id string, neg_ids array<string>"
ANSWERED_QUERY = "id string, question string, answer array<string>"
EXPORTED_QUERY = "id string, question string"
BEIR_DOCUMENT = "_id string, id string, title string, text string"
BEIR_QUERY = "_id string, id string, text string"
DEV = "map<string,array<string>>"
