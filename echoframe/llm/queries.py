"""Queries of the subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from ..plans.scratch import table
from .bpe import encode_and_decode
from .centroids import centroid_digests, clustering_sql
from .html_template import extract_main_text
from .infilling import INFILLING_SQL, infilling_digests
from .jaccard import near_duplicates
from .neighbours import nearest
from .packing import pack_balanced, pack_best_fit
from .quality import classify
from .rules import JUDGE_SQL, judge
from .secrets import secret_digests
from .sharding import assign_shards
from .suffix_tree import train_and_score


def op1_byte_bpe(spark, sf_dir):
    return encode_and_decode(table(spark, sf_dir, "documents"))


def op2_forest_neighbours(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"), k=20, query_every=20)


def op3_packed_matrix(spark, sf_dir):
    return pack_best_fit(table(spark, sf_dir, "documents"), size=2048)


def op4_suffix_tree_score(spark, sf_dir):
    return train_and_score(table(spark, sf_dir, "documents"))


def op5_ngram_jaccard(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), n=5, threshold=0.8)


def op6_html_template(spark, sf_dir):
    return extract_main_text(table(spark, sf_dir, "pages"))


def op7_balanced_packing(spark, sf_dir):
    return pack_balanced(table(spark, sf_dir, "documents"), size=4096, end_id=2)


def op8_quality_rules(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark, sf_dir):
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op10_jump_hash_shards(spark, sf_dir):
    return assign_shards(table(spark, sf_dir, "documents"), shards=8)


def op11_exponion_clusters(spark, sf_dir):
    return centroid_digests(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dimensions=64, scale=64)


def op12_secret_network(spark, sf_dir):
    return secret_digests(table(spark, sf_dir, "documents"), recall=0.95)


def op13_fill_in_middle(spark, sf_dir):
    return infilling_digests(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_forest_neighbours": op2_forest_neighbours,
    "op3_packed_matrix": op3_packed_matrix,
    "op4_suffix_tree_score": op4_suffix_tree_score,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_html_template": op6_html_template,
    "op7_balanced_packing": op7_balanced_packing,
    "op8_quality_rules": op8_quality_rules,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_jump_hash_shards": op10_jump_hash_shards,
    "op11_exponion_clusters": op11_exponion_clusters,
    "op12_secret_network": op12_secret_network,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLE_SQL: dict[str, str] = {
    "op8_quality_rules": JUDGE_SQL,
    "op11_exponion_clusters": clustering_sql(k=16, rounds=3, dimensions=64, scale=64),
    "op13_fill_in_middle": INFILLING_SQL,
}
