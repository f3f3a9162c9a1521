"""Operations of a training-data pipeline: deduplication, language and toxicity models, token output, packing, search.

Every module holds one operator with a general interface; `queries.py` registers the thin queries over the tables
and `sql.py` the SQL that states the same result where SQL can.
"""
