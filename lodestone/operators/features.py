"""Features of candidate pairs: strings, tokens, numbers, structure, blockers and competition among pairs."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.similarity import SCORERS, dot, number_overlap, string_similarity, token_overlap
from lodestone.functions.text import tokens
from lodestone.operators.blocking import BLOCKER_BITS, group_rank
from lodestone.operators.links import compared, gathered

#: Groups of features that can be switched off.
GROUPS = ["string", "tokens", "tfidf", "numbers", "structure", "blockers", "pruner", "rank"]
#: Fields of the string group, by prefix.
STRING_FIELDS = {"name": "name_norm", "name_core": "name_core", "addr": "address_norm"}
#: Features of the pruner: name, field, scorer. None has a guard against empty strings.
PRUNER_STRINGS = [
    ("p_name_core_ratio", "name_core", "ratio"),
    ("p_name_core_token_set", "name_core", "token_set_ratio"),
    ("p_name_jw", "name_norm", "jaro_winkler"),
    ("p_addr_token_set", "address_norm", "token_set_ratio"),
    ("p_addr_partial", "address_norm", "partial_ratio"),
]
_KEYS = ["s1_id", "tgt_id"]


def _flag(x: Column, name: str) -> Column:
    return F.coalesce(x, F.lit(False)).cast("double").alias(name)


def structure_features() -> list[Column]:
    """Matches and gaps of postal codes, house numbers, countries and lengths, of columns s1_<c> and cand_<c>."""
    a, b = tokens(F.col("s1_postal_codes")), tokens(F.col("cand_postal_codes"))
    has = lambda c: F.col(c) != ""
    size = lambda c: F.length(c).cast("double")
    out = [
        _flag(F.arrays_overlap(a, b), "postal_code_match"),
        _flag((F.size(a) > 0) & (F.size(b) > 0), "postal_code_both_present"),
        _flag((F.size(a) > 0) | (F.size(b) > 0), "postal_code_either_present"),
    ]
    for name, field in (("house_number", "house_number"), ("country", "country_norm")):
        left, right = f"s1_{field}", f"cand_{field}"
        out += [_flag(has(left) & (F.col(left) == F.col(right)), f"{name}_match"), _flag(has(left) & has(right), f"{name}_both_present")]
    for name, field in (("name", "name_norm"), ("addr", "address_norm")):
        left, right = size(f"s1_{field}"), size(f"cand_{field}")
        out += [left.alias(f"s1_{name}_len"), right.alias(f"cand_{name}_len"), F.abs(left - right).alias(f"{name}_len_diff")]
        if name == "name":
            out.append((F.least(left, right) / F.greatest(left, right, F.lit(1.0))).alias("name_len_ratio"))
        out += [(left == 0).cast("double").alias(f"s1_{name}_missing"), (right == 0).cast("double").alias(f"cand_{name}_missing")]
    return out


def group_max(groups: list[str], value: Column) -> Column:
    return F.max(value).over(Window.partitionBy(*groups))


def rank_features(pairs: DataFrame, sims: dict[str, str]) -> DataFrame:
    """pairs with each pair's place among those of its S1 record and of its candidate, for similarities {key: column}.

    Ranks, gaps to the best, mutual best, and the numbers of competitors; over all pairs of the input, in two shuffles.
    """
    names = {}
    for key, column in sims.items():
        v = F.col(column)
        names |= {
            f"rank_{key}_in_s1": group_rank(["s1_id"], v, ["tgt_id"]),
            f"gap_{key}_to_s1_best": group_max(["s1_id"], v) - v,
        }
    out = pairs.withColumns(names | {"n_cands_for_s1": F.count("*").over(Window.partitionBy("s1_id"))})
    names = {}
    for key, column in sims.items():
        v = F.col(column)
        names |= {
            f"rank_{key}_in_cand": group_rank(["tgt_id"], v, ["s1_id"]),
            f"gap_{key}_to_cand_best": group_max(["tgt_id"], v) - v,
        }
    out = out.withColumns(names | {"n_s1_for_cand": F.count("*").over(Window.partitionBy("tgt_id"))})
    return out.withColumns({f"mutual_best_{k}": ((F.col(f"rank_{k}_in_s1") == 1) & (F.col(f"rank_{k}_in_cand") == 1)).cast("int") for k in sims})


def _scored(pairs: DataFrame, wanted: list[tuple[str, str, str]], guard: bool) -> DataFrame:
    """pairs, with s1_<field> and cand_<field>, with a column for each (name, field, scorer); one UDF call per field."""
    for field in dict.fromkeys(f for _, f, _ in wanted):
        own = {n: s for n, f, s in wanted if f == field}
        pairs = pairs.withColumn("_s", string_similarity(F.col(f"s1_{field}"), F.col(f"cand_{field}"), list(dict.fromkeys(own.values())), guard))
        pairs = pairs.withColumns({n: F.col(f"_s.{s}") for n, s in own.items()}).drop("_s")
    return pairs


def pruner_features(pairs: DataFrame, s1: DataFrame, targets: DataFrame, strings: list[tuple[str, str, str]] | None = None) -> tuple[DataFrame, list[str]]:
    """Blocking scores and ranks, the source, the number of blockers and five string similarities; and their names."""
    strings = PRUNER_STRINGS if strings is None else strings
    given = [c for c in pairs.columns if c.startswith(("score_", "rank_")) or c == "is_s2"]
    both = gathered(pairs, s1, targets, list(dict.fromkeys(f for _, f, _ in strings)))
    out = _scored(both, strings, guard=False).withColumn("n_blockers", F.bit_count("blockers"))
    names = [*given, "n_blockers", *(n for n, _, _ in strings)]
    return out.select(*pairs.columns, "n_blockers", *(n for n, _, _ in strings)), names


def build_features(pairs: DataFrame, s1: DataFrame, targets: DataFrame, groups: list[str] | None = None, embeddings: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, list[str]]:
    """pairs with all features of the matcher, kept as a table, and the features' names in order. Texts meet in rounds.

    pairs must be the complete candidate set, as ranks compare pairs with each other. With all groups and two blockers
    there are 70 features, with embeddings 74. embeddings: (entity_id, name, full), vectors of unit length, of S1 and targets.
    """
    groups = GROUPS if groups is None else groups
    fields = ["name_norm", "name_core", "address_norm", "postal_codes", "house_number", "country_norm", "address_numbers"]
    ranked, rank_names = pairs, []
    if "rank" in groups:  # before texts come with the pairs, as ranks shuffle them
        sims = {"name": "score_name", "combined": "score_combined"} | ({"pruner": "pruner_prob"} if "pruner_prob" in pairs.columns else {})
        ranked = rank_features(pairs, sims)
        rank_names = [c for c in ranked.columns if c not in pairs.columns]

    def made(out: DataFrame) -> tuple[DataFrame, list[str]]:
        """ranked, with texts, with the features of a pair by itself in their place; and the names of all."""
        names: list[str] = []

        def add(df: DataFrame, columns: list[Column]) -> DataFrame:
            new = df.select("*", *columns)
            names.extend(new.columns[len(df.columns) :])
            return new

        if "string" in groups:
            wanted = [(f"{p}_{s}", f, s) for p, f in STRING_FIELDS.items() for s in SCORERS]
            out = _scored(out, wanted, guard=True)
            names.extend(n for n, _, _ in wanted)
        if "tokens" in groups:
            out = add(out, [*token_overlap(F.col("s1_name_core"), F.col("cand_name_core"), "name"), *token_overlap(F.col("s1_address_norm"), F.col("cand_address_norm"), "addr")])
        if "numbers" in groups:
            out = add(out, number_overlap(F.col("s1_address_numbers"), F.col("cand_address_numbers")))
        if "structure" in groups:
            out = add(out, structure_features())
            names.append("is_s2")
        if "tfidf" in groups:
            out = add(out, [F.col(c).cast("double").alias(f"blk_{c}") for c in pairs.columns if c.startswith(("score_", "rank_")) and not c.endswith("embedding")])
        if "blockers" in groups:
            out = add(out, [(F.col("blockers").bitwiseAND(bit) > 0).cast("double").alias(f"found_by_{b}") for b, bit in BLOCKER_BITS.items() if f"score_{b}" in pairs.columns])
        if "pruner" in groups and "pruner_prob" in pairs.columns:
            names.append("pruner_prob")
        names.extend(rank_names)
        return out.select(*pairs.columns, *(n for n in names if n not in pairs.columns)), names

    names = made(gathered(ranked, s1, targets, fields))[1]
    out = compared(ranked, s1, targets, fields, lambda both: made(both)[0])

    def add(df: DataFrame, columns: list[Column]) -> DataFrame:
        new = df.select("*", *columns)
        names.extend(new.columns[len(df.columns) :])
        return new

    if embeddings is not None:
        left, right = (e.select(F.col("entity_id").alias(key), F.col("name").alias(f"_{side}_name"), F.col("full").alias(f"_{side}_full")) for e, key, side in zip(embeddings, ("s1_id", "tgt_id"), ("a", "b")))
        out = out.join(left, "s1_id", "left").join(right, "tgt_id", "left")
        out = add(out, [F.coalesce(dot(F.col(f"_a_{f}"), F.col(f"_b_{f}")), F.lit(0.0)).alias(f"emb_{f}_cos") for f in ("name", "full")])
        if "rank_embedding" in pairs.columns:
            out = add(out, [F.col("rank_embedding").cast("double").alias("blk_rank_embedding")])
    return out.select(*pairs.columns, *(n for n in names if n not in pairs.columns)), names


def assembled(df: DataFrame, names: list[str]) -> DataFrame:
    """df with the vector column `features`."""
    return VectorAssembler(inputCols=names, outputCol="features").transform(df)
