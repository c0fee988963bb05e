"""From a query tree to one DataFrame plan.

The postings of all terms of a query are read in one scan with the terms as a pushed-down filter, scored, and brought
together per document by one aggregate with a column per distinct term. The tree itself is a boolean and a score
expression over those columns, so any nesting costs one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import scoring
from quern.operators.indexing import Index
from quern.plans.query import AND, MUST, MUST_NOT, SHOULD, Bool, Term, parse


@dataclass(frozen=True)
class NumericFilter:
    """Closed ranges of fast fields and uid equality; missing values count as 0.

    ``ranges`` names any fast field with its least and largest value, None being open.
    """

    pubtime_lo: int | None = None
    pubtime_hi: int | None = None
    uid: int | None = None
    sort_by_pubtime: bool = False
    ranges: tuple[tuple[str, float | None, float | None], ...] = ()

    def condition(self) -> Column | None:
        parts = [between(*r) for r in self.ranges]
        if self.pubtime_lo is not None or self.pubtime_hi is not None:
            parts.append(between("pubtime", self.pubtime_lo, self.pubtime_hi))
        if self.uid is not None and self.uid >= 0:
            parts.append(between("uid", self.uid, self.uid))
        return reduce(lambda a, b: a & b, parts) if parts else None


def between(column: str, lo: float | None, hi: float | None) -> Column:
    """A closed range, in a form that the scan takes as a filter: a NULL is 0, so it counts only where 0 lies in the range."""
    inside = [F.col(column) == lo] if lo is not None and lo == hi else [F.col(column) >= lo] * (lo is not None) + [F.col(column) <= hi] * (hi is not None)
    found = reduce(lambda a, b: a & b, inside) if inside else F.lit(True)
    zero = (lo is None or lo <= 0) and (hi is None or hi >= 0)
    return found | F.col(column).isNull() if zero else found


def filter_docs(index: Index, column: str, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """``doc_id`` of the documents whose fast field lies in a closed range; none for a field that is not one."""
    known = (f := index.schema.find(column)) is not None and f.fast
    return index.docs.where(between(column, lo, hi) if known else F.lit(False)).select("doc_id")


def _evaluate(node: Term | Bool, column: dict[Term, Column]) -> tuple[Column, Column] | None:
    """(matches, score) of a node, or None where it can never match."""
    if isinstance(node, Term):
        s = column[node]
        return s.isNotNull(), F.coalesce(s, F.lit(0.0))
    wanted: dict[str, list[tuple[Column, Column]]] = {}
    for occur, child in node.clauses:
        found = _evaluate(child, column)
        if found is None:
            if occur == MUST:
                return None
            continue
        wanted.setdefault(occur, []).append(found)
    if MUST in wanted:  # optional clauses beside required ones neither match nor score
        chosen = wanted[MUST]
        matches = reduce(lambda a, b: a & b, [m for m, _ in chosen])
    elif len(wanted.keys() - {MUST_NOT}):
        chosen = next(v for k, v in wanted.items() if k != MUST_NOT)
        matches = reduce(lambda a, b: a | b, [m for m, _ in chosen])
    else:
        return None
    score = reduce(lambda a, b: a + b, [F.when(m, s).otherwise(F.lit(0.0)) for m, s in chosen])
    for excluded, _ in wanted.get(MUST_NOT, []):
        matches = matches & ~excluded
    return matches, score


def scored_postings(index: Index, terms: Sequence[Term], k1: float = scoring.K1, b: float = scoring.B) -> DataFrame:
    """(``field``, ``term``, ``doc_id``, ``s``) of the given terms."""
    wanted = reduce(lambda x, y: x | y, [(F.col("field") == t.field) & (F.col("term") == t.term) for t in terms])
    # As many rows as the query has terms.
    known = F.broadcast(index.dictionary.where(wanted).select("field", "term", "df").join(F.broadcast(index.stats.select("field", "n_docs", "avgdl")), "field"))
    s = scoring.bm25(F.col("tf"), F.col("dl"), F.col("avgdl"), F.col("n_docs"), F.col("df"), k1, b)
    return index.postings.where(wanted).join(known, ["field", "term"]).select("field", "term", "doc_id", s.alias("s"))


def matches(index: Index, tree: Term | Bool, k1: float = scoring.K1, b: float = scoring.B) -> DataFrame:
    """(``doc_id``, ``score``) of all documents that match, deleted ones left out."""
    terms = list(dict.fromkeys(tree.terms()))
    names = {t: F.col(f"_s{i}") for i, t in enumerate(terms)}
    plan = _evaluate(tree, names) if terms else None
    if plan is None:
        return index.postings.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    scored = scored_postings(index, terms, k1, b)
    columns = [F.max(F.when((F.col("field") == t.field) & (F.col("term") == t.term), F.col("s"))).alias(f"_s{i}") for i, t in enumerate(terms)]
    hit, score = plan
    found = scored.groupBy("doc_id").agg(*columns).where(hit).select("doc_id", score.alias("score"))
    return found.join(index.deleted.select("doc_id").distinct(), "doc_id", "left_anti") if index.deleted is not None else found


def pruned(index: Index, terms: Sequence[Term], k: int, k1: float = scoring.K1, b: float = scoring.B) -> DataFrame:
    """(``doc_id``, ``score``) of all documents that can be among the best ``k`` of a disjunction; others may be missing.

    No term adds more than its bound. The ``k``-th best score of the term of highest bound alone is a threshold that the
    best k reach. Terms of low bounds which together stay below it cannot lift a document there by themselves, so their
    postings count only in documents that hold one of the others: the long lists of frequent terms are cut down before
    they are brought together. Bounds are those of the dictionary, which hold for the default k1 and b.
    """
    distinct = list(dict.fromkeys(terms))
    often = {t: sum(x == t for x in terms) for t in distinct}
    scored = scored_postings(index, distinct, k1, b)
    total = lambda rows: rows.groupBy("doc_id").agg(F.sum(F.col("s") * weight).alias("score"))
    weight = reduce(lambda w, t: w.when(_is(t), often[t]), distinct[1:], F.when(_is(distinct[0]), often[distinct[0]]))
    wanted = reduce(lambda x, y: x | y, [_is(t) for t in distinct])
    idf = scoring.idf(F.col("n_docs"), F.col("df"))
    rows = index.dictionary.where(wanted).join(F.broadcast(index.stats.select("field", "n_docs")), "field").select("field", "term", (F.col("max_tf_norm") * idf).alias("bound")).collect()  # a row per term
    bounds = sorted((r.bound * often[t], r.field, r.term) for r in rows if (t := Term(r.field, r.term)) in often)
    if len(bounds) < 2 or k < 1 or (k1, b) != (scoring.K1, scoring.B):
        return total(scored)
    top = Term(*bounds[-1][1:])
    best = [r[0] for r in scored.where(_is(top)).select(F.col("s") * often[top]).orderBy(F.desc("s")).limit(k).collect()]  # k rows
    threshold = best[-1] * (1 - 1e-12) if len(best) == k else 0.0
    low, below = [], 0.0
    for bound, f, t in bounds[:-1]:
        if below + bound >= threshold:
            break
        below += bound
        low.append(Term(f, t))
    if not low:
        return total(scored)
    minor = reduce(lambda x, y: x | y, [_is(t) for t in low])
    major = scored.where(~minor)
    return total(major.unionByName(scored.where(minor).join(major.select("doc_id").distinct(), "doc_id", "left_semi").select(*major.columns)))


def _is(t: Term) -> Column:
    return (F.col("field") == t.field) & (F.col("term") == t.term)


def one_per_ext_id(found: DataFrame) -> DataFrame:
    """The best row of each ext_id, the smallest doc_id of equals; 0 and NULL are unset and always stay."""
    unset = F.col("ext_id").isNull() | (F.col("ext_id") == 0)
    best = F.min(F.struct((-F.col("score")).alias("s"), "doc_id")).alias("b")
    kept = found.where(~unset).groupBy("ext_id").agg(best).select("b.doc_id", (-F.col("b.s")).alias("score"), "ext_id")
    return kept.unionByName(found.where(unset).select("doc_id", "score", "ext_id"))


def search(index: Index, query: str | Term | Bool, k: int = 10, mode: str = AND, numeric: NumericFilter | None = None, dedup: bool = False, stored: Sequence[str] = (), fields: list[str] | None = None, k1: float = scoring.K1, b: float = scoring.B) -> DataFrame:
    """The best ``k``: (``doc_id``, ``score``, stored columns), by score and then doc_id; nothing for k <= 0.

    A filter applies before the cut, and so does the choice of one document per ext_id. ``sort_by_pubtime`` reorders the
    rows that the cut left; it adds ``pubtime``. Stored columns are fetched for the final rows only.
    """
    tree = parse(query, fields if fields is not None else index.default_fields, mode) if isinstance(query, str) else query
    plain = isinstance(tree, Bool) and tree.clauses and all(o == SHOULD and isinstance(n, Term) for o, n in tree.clauses)
    if plain and not dedup and index.deleted is None and (numeric is None or numeric.condition() is None):
        found = pruned(index, list(tree.terms()), k, k1, b)
    else:
        found = matches(index, tree, k1, b)
    condition = numeric.condition() if numeric else None
    if condition is not None:
        found = found.join(index.docs.where(condition).select("doc_id"), "doc_id", "left_semi")
    if dedup:
        found = one_per_ext_id(found.join(index.docs.select("doc_id", "ext_id"), "doc_id")).select("doc_id", "score")
    top = found.orderBy(F.desc("score"), "doc_id").limit(max(k, 0))
    late = [*stored, *(["pubtime"] if numeric and numeric.sort_by_pubtime and "pubtime" not in stored else [])]
    if late:
        top = index.docs.select("doc_id", *late).join(F.broadcast(top), "doc_id").select("doc_id", "score", *late)  # k rows
        order = [F.desc(F.coalesce("pubtime", F.lit(0)))] if numeric and numeric.sort_by_pubtime else []
        top = top.orderBy(*order, F.desc("score"), "doc_id")
    return top
