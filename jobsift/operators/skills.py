"""Skill vocabulary merging.

N5 replaces the reference's delete-while-iterating loop (Q12) by a leader
election with a fixed vectoriser per round: skills are ranked by frequency
(then name); a skill is a leader unless a higher-ranked *leader* has it among
its k nearest skills within the distance threshold.  The election is
resolved in rounds over an edge table; each round's state is checkpointed so
lineage stays short, and the loop ends when no skill is undecided (the
number of rounds is the longest chain of dependent decisions, not the data
size).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsift.operators import tfidf
from jobsift.session import materialize


def skill_counts(vacancies: DataFrame, col: str = "keySkills", min_count: int = 10) -> DataFrame:
    """Skill frequencies (A2) kept when >= min_count (A3): (skill, cnt)."""
    return (vacancies.select(F.explode(col).alias("skill")).groupBy("skill").agg(F.count("*").alias("cnt"))
            .filter(F.col("cnt") >= min_count))


def skill_neighbours(skills: DataFrame, k: int = 15) -> DataFrame:
    """The k nearest skills of every skill by TF-IDF cosine (itself
    included), vectoriser fitted on the skill list: (skill, neighbour, score, rank)."""
    docs = skills.select(F.col("skill").alias("vacancy_id"), F.col("skill").alias("text"))
    out = tfidf.tfidf_top_k(None, docs, k)
    return out.select(F.col("query_id").alias("skill"), F.col("vacancy_id").alias("neighbour"), "score", "rank")


def elect_leaders(counts: DataFrame, k: int = 15, threshold: float = 0.5) -> DataFrame:
    """N5, one round of merging: (skill, leader) for every skill."""
    prio = counts.select("skill", F.struct((-F.col("cnt")).alias("c"), F.col("skill").alias("s")).alias("p"))
    nn = skill_neighbours(counts.select("skill"), k).filter(
        (F.col("neighbour") != F.col("skill")) & (1 - F.col("score") <= threshold))
    edges = (nn.join(prio, "skill").withColumnRenamed("p", "p_src")
             .join(prio.withColumnRenamed("skill", "neighbour").withColumnRenamed("p", "p_dst"), "neighbour")
             .filter(F.col("p_src") < F.col("p_dst"))
             .select(F.col("skill").alias("src"), "p_src", F.col("neighbour").alias("dst")))
    edges = materialize(edges)
    # state: leader = skill itself, follower = its leader, null = undecided
    state = materialize(prio.select("skill", "p", F.lit(None).cast("string").alias("leader")))
    # each round decides at least the highest-ranked undecided skill, so this ends
    while not state.filter(F.col("leader").isNull()).isEmpty():
        src_state = state.select(F.col("skill").alias("src"), F.col("leader").alias("src_leader"))
        e = edges.join(src_state, "src")
        inc = e.groupBy("dst").agg(
            F.count(F.when(F.col("src_leader").isNull(), 1)).alias("n_open"),
            F.min_by(F.when(F.col("src_leader") == F.col("src"), F.col("src")),
                     F.when(F.col("src_leader") == F.col("src"), F.col("p_src"))).alias("best_leader"))
        s = state.join(inc.withColumnRenamed("dst", "skill"), "skill", "left")
        # decide once every higher-ranked neighbour is decided: follow the
        # highest-ranked leader among them, else lead
        ready = F.coalesce(F.col("n_open"), F.lit(0)) == 0
        decided = (F.when(F.col("leader").isNotNull(), F.col("leader"))
                   .when(ready, F.coalesce(F.col("best_leader"), F.col("skill"))))
        state = materialize(s.select("skill", "p", decided.alias("leader")))
    return state.select("skill", "leader")


def merge_skills(vacancies: DataFrame, col: str = "keySkills", min_count: int = 10, k: int = 15,
                 thresholds=(0.5, 0.65)) -> DataFrame:
    """Rounds of leader election (second round among the first round's
    leaders): final (skill, leader)."""
    counts = skill_counts(vacancies, col, min_count)
    mapping = None
    current = counts
    for t in thresholds:
        m = elect_leaders(current, k, t)
        if mapping is None:
            mapping = m
        else:
            mapping = mapping.join(m.select(F.col("skill").alias("leader"), F.col("leader").alias("leader2")),
                                   "leader", "left") \
                .select("skill", F.coalesce("leader2", "leader").alias("leader"))
        leaders = m.filter(F.col("skill") == F.col("leader")).select("skill")
        current = counts.join(leaders, "skill")
    return materialize(mapping)


def replace_skills(df: DataFrame, key: str, col: str, mapping: DataFrame) -> DataFrame:
    """Every skill replaced by its leader, order and duplicates kept;
    skills outside the mapping are dropped (Q11); a null list stays null."""
    ex = df.select(key, F.posexplode(col).alias("__pos", "skill"))
    j = ex.join(mapping, "skill")
    regroup = j.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__pos", "leader"))).alias("__s"))
    base = df.select(key, F.col(col).isNull().alias("__null"))
    out = base.join(regroup, key, "left")
    return out.select(key, F.when(F.col("__null"), F.lit(None)).otherwise(
        F.coalesce(F.transform("__s", lambda x: x["leader"]), F.array().cast("array<string>"))).alias(col))


def reduction_totals(mapping: DataFrame) -> DataFrame:
    """Number of leaders and number of merged (absorbed) skills."""
    return mapping.agg(F.count_distinct("leader").alias("n_leaders"),
                       F.sum(F.when(F.col("skill") != F.col("leader"), 1).otherwise(0)).alias("n_merged"))
