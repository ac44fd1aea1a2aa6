"""Named queries over the test tables and, where SQL can say it, the same result in ANSI SQL."""

from lexweave.plans import corpus, corpus_sql, navigate, quality, retrieval, structure, texts

QUERIES = {**corpus.QUERIES, **retrieval.QUERIES, **structure.QUERIES, **quality.QUERIES, **texts.QUERIES, **navigate.QUERIES}
SQL = {**corpus_sql.SQL, **retrieval.SQL, **structure.SQL, **quality.SQL, **texts.SQL, **navigate.SQL}
