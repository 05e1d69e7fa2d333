"""Queries of the operators for training data, over the whole tables, with their SQL where SQL can express them."""

from __future__ import annotations

from quarry.llm import docs, mixing, neardup, origin, quality, secrets, split, syntax, tokens
from quarry.sources.tables import table

QUERIES = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# -- 2: source files that do not parse ------------------------------------------------------------------------------------
def _files(spark, d):
    return table(spark, d, "files", "id", "file_path", "file_content")


@query
def p2_found(spark, d):
    return syntax.broken_files(_files(spark, d)).select("file_id")


@query
def p2_rates(spark, d):
    return syntax.rates(syntax.check_files(_files(spark, d)))


# -- 3: splitting oversized items at natural boundaries -------------------------------------------------------------------
def _items(spark, d):
    return split.entities(table(spark, d, "files", "id", "file_content"), table(spark, d, "definitions", "id", "source_code"))


@query
def p3_found(spark, d):
    return split.split_entities(_items(spark, d), table(spark, d, "split_limits")).select("entity_type", "entity_id", "cut_kind")


@query
def p3_pieces(spark, d):
    return split.split(_items(spark, d), table(spark, d, "split_limits")).distinct()


SQL["p3_found"] = r"""
WITH items AS (SELECT 'file' AS entity_type, id AS entity_id, file_content AS text FROM files
  UNION ALL SELECT 'definition', id, source_code FROM definitions)
SELECT DISTINCT i.entity_type, i.entity_id,
  CASE WHEN list_max(list_transform(string_split(i.text, chr(10)), lambda x: length(rtrim(x, chr(13))))) > l.max_chars THEN 'forced' ELSE 'natural' END AS cut_kind
FROM items i JOIN split_limits l USING (entity_type) WHERE length(i.text) > l.max_chars"""


# -- 4: functions paired with their documentation -------------------------------------------------------------------------
def _definitions(spark, d):
    return table(spark, d, "definitions", "id", "name", "definition_type", "docstring", "source_code")


@query
def p4_found(spark, d):
    return docs.code_pairs(_definitions(spark, d), with_code=False).select("definition_id").distinct()


@query
def p4_pairs(spark, d):
    return docs.code_pairs(_definitions(spark, d)).distinct()


# -- 5: credentials embedded in source code -------------------------------------------------------------------------------
def _entities(spark, d):
    return secrets.entities(_files(spark, d), table(spark, d, "definitions", "id", "source_code"))


@query
def p5_found(spark, d):
    return secrets.find(_entities(spark, d)).select("entity_type", "entity_id", "line_no").distinct()


@query
def p5_redacted(spark, d):
    return secrets.redact(_entities(spark, d)).distinct()


# -- 6: near-duplicate records with small edits ---------------------------------------------------------------------------
def _near(spark, d):
    return neardup.NearDuplicates(neardup.records_of(table(spark, d, "definitions", "id", "definition_type", "source_code")))


@query
def p6_found(spark, d):
    return _near(spark, d).expanded().select("def_id_a", "def_id_b")


@query
def p6_groups(spark, d):
    return _near(spark, d).groups()


# -- 7: generated, minified or vendored source files ----------------------------------------------------------------------
@query
def p7_found(spark, d):
    return origin.foreign_files(_files(spark, d)).select("file_id")


@query
def p7_by_repository(spark, d):
    return origin.origin_rates(origin.origins(_files(spark, d)))


# -- 8: encoding of the whole corpus with a public tokenizer --------------------------------------------------------------
def _vocabulary(spark) -> str:
    """The folder of the vocabulary files is a setting of the session, with the usual place as its default."""
    return spark.conf.get("quarry.tokenizers", tokens.DEFAULT_FOLDER) + "/" + tokens.DEFAULT_FILE


@query
def p8_ids(spark, d):
    return tokens.encode_documents(table(spark, d, "documents", "doc_id", "text"), _vocabulary(spark))


# -- 9: mixing sources to target weights ----------------------------------------------------------------------------------
def _mix(spark, d):
    documents = table(spark, d, "documents", "doc_id", "text", "source")
    return mixing.Mix(documents, table(spark, d, "mix_targets"), table(spark, d, "common_words", "word"), _vocabulary(spark))


@query
def p9_mix(spark, d):
    return _mix(spark, d).chosen()


@query
def p9_shares(spark, d):
    return _mix(spark, d).shares()


# -- 10: per-document text quality statistics -----------------------------------------------------------------------------
def _typed(spark, d):
    return quality.text_types(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "common_words", "word"))


@query
def p10_found(spark, d):
    return _typed(spark, d).filter("text_type <> 'prose'").select("doc_id")


@query
def p10_statistics(spark, d):
    return _typed(spark, d)


@query
def p10_votes(spark, d):
    return quality.vote_accuracies(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "common_words", "word"))
