"""Texts that describe concepts and candidates to encoders, rerankers and language models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from termloom.functions.text import ColumnOrName, col, strip


def _filled(c: Column) -> Column:
    """Null where the text is null or blank."""
    return F.when(strip(c) != "", strip(c))


def names(synonyms: ColumnOrName) -> Column:
    """Synonyms in order without blanks and repetitions."""
    return F.array_distinct(F.filter(F.coalesce(col(synonyms), F.array().cast("array<string>")), lambda x: F.trim(x) != ""))


def gold_text(name: ColumnOrName, definition: ColumnOrName, synonyms: ColumnOrName) -> Column:
    """``Name. Definition Synonyms: a, b.`` without the parts that are missing."""
    syn = names(synonyms)
    parts = [F.concat(F.coalesce(col(name), F.lit("")), F.lit(".")), _filled(col(definition)), F.when(F.size(syn) > 0, F.concat(F.lit("Synonyms: "), F.array_join(syn, ", "), F.lit(".")))]
    return F.concat_ws(" ", *parts)


def tagged_text(cid: ColumnOrName, name: ColumnOrName, synonyms: ColumnOrName, definition: ColumnOrName, extra: ColumnOrName | None = None, most: int | None = 3, model: ColumnOrName | None = None) -> Column:
    """One tagged line each for id, name (the id where there is none), synonyms, definition, a model's definition and an added one.

    For an encoder (``most`` synonyms) the model's definition stands in where
    there is no definition; for a prompt (``most`` None: all synonyms) it has a
    line of its own unless it is the same.
    """
    syn = names(synonyms)
    syn = F.slice(syn, 1, most) if most else syn
    d = _filled(col(definition))
    lines = [F.concat(F.lit("[HPO_ID] "), col(cid)), F.concat(F.lit("[NAME] "), F.coalesce(_filled(col(name)), col(cid))), F.when(F.size(syn) > 0, F.concat(F.lit("[SYN] "), F.array_join(syn, "; "))), F.concat(F.lit("[DEF] "), d)]
    if model is not None:
        m = _filled(col(model))
        lines.append(F.when(d.isNull() if most else ~m.eqNullSafe(d), F.concat(F.lit("[LLM_DEF] "), m)))
    if extra is not None:
        lines.append(F.concat(F.lit("[ADD_DEF] "), _filled(col(extra))))
    return F.concat_ws("\n", *lines)


def prompt_info(record: ColumnOrName, cid: ColumnOrName) -> Column:
    """struct(hpo_id, hpo_name, hpo_def, hpo_synonyms) of a map<string, array<string>> of an entry's fields, under whichever key they stand.

    The name falls back to the id, a missing definition is empty, missing synonyms are none.
    """

    def values(*keys: str) -> Column:
        filled = [F.filter(F.try_element_at(col(record), F.lit(k)), lambda x: strip(x) != "") for k in keys]
        return F.coalesce(*[F.when(F.size(v) > 0, v) for v in filled])

    first = lambda v: F.get(v, F.lit(0))
    name = F.coalesce(first(values("Name", "name", "label", "preferred_label")), col(cid))
    synonyms = F.coalesce(values("Synonym", "synonym"), F.array().cast("array<string>"))
    return F.struct(col(cid).alias("hpo_id"), name.alias("hpo_name"), F.coalesce(first(values("Def", "def")), F.lit("")).alias("hpo_def"), synonyms.alias("hpo_synonyms"))


def with_plain_names(candidates: Column) -> Column:
    """An array of candidates with ``name``, ``def`` and ``synonyms`` beside the fields named with a prefix."""
    return F.transform(candidates, lambda c: c.withField("name", c["hpo_name"]).withField("def", c["hpo_def"]).withField("synonyms", c["hpo_synonyms"]))


def name_span(text: Column, name: ColumnOrName) -> Column:
    """struct(c0, c1): the first place of the name in the text, all of the text if it isn't there."""
    at = F.instr(text, col(name))
    return F.when(at > 0, F.struct((at - 1).alias("c0"), (at - 1 + F.length(col(name))).alias("c1"))).otherwise(F.struct(F.lit(0).alias("c0"), F.length(text).alias("c1")))


def candidate_block(candidates: Column, most: int = 35) -> Column:
    """Numbered blocks of id, name, definition and synonyms, with an empty line between."""

    def block(c: Column, i: Column) -> Column:
        lines = [F.concat(F.lit("["), i.cast("string"), F.lit("]"))]
        lines += [F.concat(F.lit(f"  {label}: "), F.coalesce(value, F.lit(""))) for label, value in (("ID", c["hpo_id"]), ("Name", c["hpo_name"]), ("Definition", c["hpo_def"]), ("Synonyms", F.array_join(names(c["hpo_synonyms"]), "; ")))]
        return F.concat_ws("\n", *lines)

    return F.array_join(F.transform(F.slice(candidates, 1, most), block), "\n\n")


def compact_candidates(candidates: Column) -> Column:
    """``number. id<tab>name`` lines."""
    return F.array_join(F.transform(candidates, lambda c, i: F.concat(i.cast("string"), F.lit(". "), c["hpo_id"], F.lit("\t"), F.coalesce(c["hpo_name"], F.lit("")))), "\n")


def compact_hints(hints: Column, most: int = 12) -> Column:
    """``- hint [polarity]`` lines."""
    return F.array_join(F.transform(F.slice(hints, 1, most), lambda h: F.concat(F.lit("- "), h["hint_en"], F.lit(" ["), h["polarity"], F.lit("]"))), "\n")


def rendered(template: ColumnOrName, **values: Column) -> Column:
    """A template with ``{{name}}`` (or ``{name}``) replaced by each value; a null value as nothing.

    ``candidates`` also fills ``{{candidates_list}}``.  A template without any
    place for ``text`` has it appended.
    """
    out = F.lit(template) if isinstance(template, str) else template
    before = out
    for name, value in values.items():
        v = F.coalesce(value.cast("string"), F.lit(""))
        for mark in (f"{{{{{name}}}}}", f"{{{{{name}_list}}}}", f"{{{name}}}"):
            out = F.replace(out, F.lit(mark), v)
        if name == "text":
            out = F.when(before.contains("{text}") | before.contains("{{text}}"), out).otherwise(F.concat(out, F.lit("\n"), v))
    return out


def evidence_context(evidence: ColumnOrName, hints: Column) -> Column:
    return F.concat(F.lit("EVIDENCE:\n"), F.coalesce(col(evidence), F.lit("")), F.lit("\n\nHINTS:\n"), F.coalesce(hints, F.lit("")))


def rerank_pair(instruction: str, query: ColumnOrName, document: Column) -> Column:
    return F.concat(F.lit(f"<Instruct>: {instruction}\n<Query>: "), F.coalesce(col(query), F.lit("")), F.lit("\n<Document>: "), F.coalesce(document, F.lit("")))
