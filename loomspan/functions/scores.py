"""Similarities, probabilities and edit scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspan.functions import text as tx


def jaccard(a: Column, b: Column) -> Column:
    """Of arrays of distinct elements; null if both are empty. The common part is computed once."""
    shared = F.size(F.array_intersect(a, b))
    return ratio(shared, F.size(a) + F.size(b) - shared)


def ratio(shared: Column, whole: Column) -> Column:
    return shared.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def containment(query: Column, doc: Column) -> Column:
    return ratio(F.size(F.array_intersect(query, doc)), F.size(query))


def edit_similarity(pred: Column, target: Column) -> Column:
    """1 - Levenshtein distance / longer length; 0 if both are empty."""
    longer = F.greatest(F.length(pred), F.length(target))
    return F.when(longer == 0, F.lit(0.0)).otherwise(1 - F.levenshtein(pred, target) / longer.cast("double"))


def exact_match(pred: Column, target: Column) -> Column:
    return tx.code_tokens(pred) == tx.code_tokens(target)


def exact_match_lines(pred: Column, target: Column) -> Column:
    """Equal lists of trimmed, non-blank lines after comments are gone."""
    clean = lambda t: F.transform(tx.nonblank_lines(tx.strip_comments(t)), tx.strip)
    return clean(pred) == clean(target)


def id_match(pred_ids: Column, target_ids: Column) -> Column:
    """Struct tp, fp, fn, em, precision, recall, f1 on sets of identifiers; em compares the lists."""
    p, t = F.array_distinct(pred_ids), F.array_distinct(target_ids)
    tp = F.size(F.array_intersect(p, t))
    precision = F.when(F.size(p) == 0, 0.0).otherwise(tp / F.size(p).cast("double"))
    recall = F.when(F.size(t) == 0, 0.0).otherwise(tp / F.size(t).cast("double"))
    f1 = F.when(tp == 0, 0.0).otherwise(2 * tp / (F.size(p) + F.size(t)).cast("double"))
    return F.struct(tp.alias("tp"), (F.size(p) - tp).alias("fp"), (F.size(t) - tp).alias("fn"), (pred_ids == target_ids).cast("int").alias("em"), precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def softmax_at(scores: Column, k: Column | int) -> Column:
    """Probability of entry k (from 0) of an array of logits or log-probabilities; shifted by the maximum first."""
    k = k if isinstance(k, Column) else F.lit(k)
    whole = lambda top: F.aggregate(scores, F.lit(0.0), lambda s, x: s + F.exp(x.cast("double") - top))
    return tx.let(F.array_max(scores).cast("double"), lambda top: F.exp(F.get(scores, k).cast("double") - top) / whole(top))


def _softmax(logits: Column) -> Column:
    top = F.array_max(logits).cast("double")
    powers = tx.let(top, lambda t: F.transform(logits, lambda x: F.exp(x.cast("double") - t)))
    total = lambda p: F.aggregate(p, F.lit(0.0), lambda s, y: s + y)
    return tx.let(powers, lambda p: tx.let(total(p), lambda z: F.transform(p, lambda x: x / z)))


def token_uncertainty(logits: Column) -> Column:
    """Struct max_prob, entropy (nats) of one token's logits."""
    return tx.let(_softmax(logits), _peak_and_entropy)


def _peak_and_entropy(p: Column) -> Column:
    return F.struct(F.array_max(p).alias("max_prob"), F.aggregate(p, F.lit(0.0), lambda s, x: s - F.when(x > 0, x * F.ln(x)).otherwise(0.0)).alias("entropy"))


def sequence_uncertainty(tokens: Column) -> Column:
    """From an array of token_uncertainty structs in order: first, least and mean probability, first and mean entropy."""
    mean = lambda name: F.aggregate(tokens, F.lit(0.0), lambda s, x: s + x[name]) / F.size(tokens)
    first = F.get(tokens, F.lit(0))
    return F.struct(
        first["max_prob"].alias("max_prob_first_token"),
        F.array_min(F.transform(tokens, lambda x: x["max_prob"])).alias("max_prob_lower_bound"),
        mean("max_prob").alias("max_prob_all_tokens"),
        first["entropy"].alias("entropy_first_token"),
        mean("entropy").alias("entropy_all_tokens"),
    )


def rank_of(logits: Column, k: Column | int) -> Column:
    """1 + the number of entries above entry k (from 0)."""
    own = F.get(logits, F.lit(k))
    return F.size(F.filter(logits, lambda x: x > own)) + 1


def mean_log_prob(log_probs: Column, length: Column) -> Column:
    kept = tx.head(log_probs, length)
    return F.aggregate(kept, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.nullif(length.cast("double"), F.lit(0.0))


def masked_mean(vectors: Column, mask: Column) -> Column:
    """Mean of the token vectors whose mask is 1, over at least 1e-9."""
    kept = F.zip_with(vectors, mask, lambda v, m: F.transform(v, lambda x: x.cast("double") * m))
    weight = F.greatest(F.aggregate(mask, F.lit(0.0), lambda s, m: s + m.cast("double")), F.lit(1e-9))
    zero = F.transform(F.get(vectors, F.lit(0)), lambda x: F.lit(0.0))
    return F.transform(F.aggregate(kept, zero, lambda s, v: F.zip_with(s, v, lambda a, b: a + b)), lambda x: x / weight)


def max_similarity(query: Column, doc: Column) -> Column:
    """Late interaction: mean over query token vectors of the best cosine with a document token vector."""
    best = F.transform(query, lambda q: F.array_max(F.transform(doc, lambda d: cosine(q, d))))
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))) / F.nullif(F.size(query), F.lit(0))


def line_weights(n_left: Column, n_right: Column, version: int) -> Column:
    """Weights of the query's lines: 1 next to the hole, falling as 1 / (i + 1) or e^-i away from it. An empty side still has one weight."""
    fall = (lambda i: 1 / (i.cast("double") + 1)) if version == 1 else (lambda i: F.exp(-i.cast("double")))
    side = lambda n: F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), fall)
    return F.concat(F.reverse(side(n_left)), side(n_right))
