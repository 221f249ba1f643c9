"""Decision workflows: one per document from its facts, and checks of any workflow graph.

Nodes are one wide table (doc_id, node_id, node_type, condition, true_next, false_next, action, label, requires_human_review,
citations); edges (doc_id, src, dst, branch) come from decisions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions import text as T
from quirefold.operators.facts import CITATION

# The workflow's inputs, nodes and warnings.
INPUTS = (
    ("in001", "meets_population", "bool", "True if the patient matches the guideline population definition."),
    ("in002", "has_exclusion_or_contraindication", "bool", "True if any guideline exclusion or contraindication applies."),
    ("in003", "has_red_flags", "bool", "True if any guideline red flag is present."),
)
DECISIONS = (
    ("d0001", "in001 == true", "d0002", "e0001", "population"),
    ("d0002", "in002 == true", "e0002", "d0003", "excluded"),
    ("d0003", "in003 == true", "a0001", "a0002", "red_flag"),
)
ACTIONS = (
    ("a0001", "Guideline red flags present: escalate to urgent evaluation / clinician-directed management per guideline context.", "red_flag"),
    (
        "a0002",
        "No exclusions/contraindications and no red flags detected. Review the extracted guideline facts and apply clinically."
        " This workflow is a structured summary, not autonomous medical decision-making.",
        "review",
    ),
)
ENDS = (("e0001", "Not applicable (outside population)"), ("e0002", "Excluded / contraindicated"))
ABSENT = (
    ("population", "Step7: no POPULATION facts found; population gate may require manual interpretation."),
    ("excluded", "Step7: no EXCLUSION/CONTRAINDICATION facts found; exclusion gate may be incomplete."),
    ("red_flag", "Step7: no RED_FLAG facts found; the red-flag decision node is a template gate with no fact-derived criteria in this run."),
)
START, REVIEW_CITATIONS = "d0001", 8


def _buckets() -> dict[str, Column]:
    return {
        "population": F.col("fact_type") == "population",
        "excluded": F.col("fact_type").isin("exclusion", "contraindication"),
        "red_flag": F.col("fact_type") == "red_flag",
        "review": F.col("requires_human_review"),
    }


def first_citations(facts: DataFrame) -> DataFrame:
    """(doc_id, fact order, citation) with each span once for every bucket: (doc_id, bucket, citations). The first of a span wins,
    quote or not."""
    cited = facts.select("doc_id", "fact_id", *[c.alias(b) for b, c in _buckets().items()], F.posexplode("citations").alias("nth", "c"))
    tagged = cited.select("doc_id", "fact_id", "nth", "c.*", F.explode(F.array_compact(F.array(F.lit("all"), *[F.when(F.col(b), F.lit(b)) for b in _buckets()]))).alias("bucket"))
    span = ["doc_id", "bucket", "chunk_id", "line_start", "line_end"]
    once = tagged.groupBy(*span).agg(F.min_by(F.struct("quote"), F.struct("fact_id", "nth")).alias("q"))
    row = F.struct("chunk_id", "line_start", "line_end", F.col("q.quote").alias("quote"))
    return once.groupBy("doc_id", "bucket").agg(F.array_sort(F.collect_list(row)).alias("citations"))


def _bucketed(facts: DataFrame) -> DataFrame:
    """One row a document: facts in each bucket, and each bucket's citations."""
    counts = facts.groupBy("doc_id").agg(F.count("*").alias("n_all"), *[F.count_if(c).alias(f"n_{b}") for b, c in _buckets().items()])
    lists = first_citations(facts).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "citations"))).alias("m"))
    none = F.array().cast(f"array<{CITATION}>")
    out = counts.join(lists, "doc_id", "left")
    got = lambda b: F.coalesce(F.try_element_at("m", F.lit(b)), none)
    review = F.when(F.col("n_review") > 0, got("review")).otherwise(got("all"))
    return out.select("*", got("population").alias("c_population"), got("excluded").alias("c_excluded"), got("red_flag").alias("c_red_flag"), review.alias("full_review"), F.slice(review, 1, REVIEW_CITATIONS).alias("c_review")).drop("m")


def workflow_nodes(facts: DataFrame) -> DataFrame:
    """The seven nodes of each document's workflow."""
    none, no_text = F.lit(None).cast(f"array<{CITATION}>"), F.lit(None).cast("string")

    def node(node_id, kind, condition=no_text, true_next=no_text, false_next=no_text, action=no_text, label=no_text, review=F.lit(None).cast("boolean"), citations=none):
        return F.struct(
            F.lit(node_id).alias("node_id"), F.lit(kind).alias("node_type"), condition.alias("condition"), true_next.alias("true_next"), false_next.alias("false_next"),
            action.alias("action"), label.alias("label"), review.alias("requires_human_review"), citations.alias("citations"),
        )

    nodes = [node(i, "decision", F.lit(c), F.lit(t), F.lit(f), citations=F.col(f"c_{b}")) for i, c, t, f, b in DECISIONS]
    nodes += [node(i, "action", action=F.lit(a), review=F.lit(True), citations=F.col(f"c_{b}")) for i, a, b in ACTIONS]
    nodes += [node(i, "end", label=F.lit(x)) for i, x in ENDS]
    return _bucketed(facts).select("doc_id", F.inline(F.array(*nodes)))


def workflow_edges(nodes: DataFrame) -> DataFrame:
    """(doc_id, src, dst, branch) of decisions."""
    both = F.array(F.struct(F.col("true_next").alias("dst"), F.lit(True).alias("branch")), F.struct(F.col("false_next").alias("dst"), F.lit(False).alias("branch")))
    return nodes.where("node_type = 'decision'").select("doc_id", F.col("node_id").alias("src"), F.inline(both))


def workflow_meta(facts: DataFrame) -> DataFrame:
    return _bucketed(facts).select(
        "doc_id", F.col("n_all").alias("num_facts"), F.col("n_population").alias("num_population_facts"), F.col("n_excluded").alias("num_excl_contra_facts"), F.col("n_red_flag").alias("num_red_flag_facts"),
        F.col("n_review").alias("num_review_facts"), F.size("full_review").cast("long").alias("review_citations_available"), F.size("c_review").cast("long").alias("review_citations_emitted"),
    )


def workflow_headers(facts: DataFrame) -> DataFrame:
    """(doc_id, workflow_id, guideline_id, start_node_id, requires_human_review, warnings)."""
    guideline = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    warnings = F.array_compact(F.array(*[F.when(F.col(f"n_{b}") == 0, F.lit(text)) for b, text in ABSENT]))
    return _bucketed(facts).select("doc_id", F.concat(guideline, F.lit("__v1")).alias("workflow_id"), guideline.alias("guideline_id"), F.lit(START).alias("start_node_id"), F.lit(True).alias("requires_human_review"), warnings.alias("warnings"))


def workflow_inputs(facts: DataFrame) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(i).alias("input_id"), F.lit(n).alias("name"), F.lit(t).alias("type"), F.lit(d).alias("description")) for i, n, t, d in INPUTS])
    return facts.select("doc_id").distinct().select("doc_id", F.inline(rows))


# Checks of any graph.


def duplicate_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("doc_id", "node_id").count().where("count > 1").select("doc_id", "node_id")


def missing_starts(headers: DataFrame, nodes: DataFrame) -> DataFrame:
    starts = headers.select("doc_id", F.col("start_node_id").alias("node_id"))
    return starts.join(nodes.select("doc_id", "node_id"), ["doc_id", "node_id"], "left_anti")


def dangling_edges(nodes: DataFrame) -> DataFrame:
    edges = workflow_edges(nodes)
    return edges.join(nodes.select("doc_id", F.col("node_id").alias("dst")), ["doc_id", "dst"], "left_anti").select("doc_id", "src", "dst", "branch")


def reachable(headers: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id) of what can be reached from the start.

    A graph is small and its document's own, so it is one row while it is walked: each of at most as many steps as it has
    nodes adds the targets of what was found. Cycles end the walk, as nothing is added.
    """
    edges = workflow_edges(nodes).groupBy("doc_id").agg(F.collect_list(F.struct("src", "dst")).alias("edges"))
    known = nodes.groupBy("doc_id").agg(F.collect_set("node_id").alias("nodes"))
    graph = headers.select("doc_id", "start_node_id").join(known, "doc_id").join(edges, "doc_id", "left")
    links = F.coalesce("edges", F.array().cast("array<struct<src:string,dst:string>>"))

    def step(found: Column, _: Column) -> Column:
        return F.array_union(found, F.transform(F.filter(links, lambda e: F.array_contains(found, e["src"])), lambda e: e["dst"]))

    found = F.aggregate("nodes", F.array(F.col("start_node_id")), step)
    return graph.select("doc_id", F.explode(F.array_intersect(found, F.col("nodes"))).alias("node_id"))


def unreachable(headers: DataFrame, nodes: DataFrame) -> DataFrame:
    return nodes.select("doc_id", "node_id").distinct().join(reachable(headers, nodes), ["doc_id", "node_id"], "left_anti")


def graph_violations(headers: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, ordinal, rule, entity) of every graph check."""
    parts = (
        (duplicate_nodes(nodes), 1, "duplicate_node", "node_id"),
        (missing_starts(headers, nodes), 2, "missing_start", "node_id"),
        (dangling_edges(nodes), 3, "dangling_edge", "dst"),
        (unreachable(headers, nodes), 4, "unreachable_node", "node_id"),
    )
    rows = [df.select("doc_id", F.lit(k).alias("ordinal"), F.lit(rule).alias("rule"), F.col(c).alias("entity")) for df, k, rule, c in parts]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def decision_chain(headers: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, step, node_id): decisions from the start on, by the true branch if it leads to a decision, else by the false one;
    ends at a node seen before."""
    row = F.struct("node_id", "node_type", "true_next", "false_next")
    graph = headers.select("doc_id", "start_node_id").join(nodes.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("node_id", row))).alias("m")), "doc_id")
    kind = lambda i: F.try_element_at("m", i)["node_type"]
    start = F.struct(F.when(kind(F.col("start_node_id")) == "decision", F.col("start_node_id")).alias("at"), F.array().cast("array<string>").alias("chain"))

    def step(s: Column, _: Column) -> Column:
        here = F.try_element_at("m", s["at"])
        t, f = here["true_next"], here["false_next"]
        to = F.when((t == "") | (f == ""), F.lit(None)).when(t.isNull() | f.isNull(), F.lit(None)).when(kind(t) == "decision", t).when(kind(f) == "decision", f)
        chain = F.concat(s["chain"], F.array(s["at"]))
        go = s["at"].isNotNull()
        return F.struct(F.when(go & ~F.array_contains(chain, to), to).alias("at"), F.when(go, chain).otherwise(s["chain"]).alias("chain"))

    chain = F.aggregate(F.map_keys("m"), start, step, lambda s: s["chain"])
    return graph.select("doc_id", F.posexplode(chain).alias("step", "node_id")).select("doc_id", (F.col("step") + 1).cast("long").alias("step"), "node_id")


def next_steps(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, branch, next_id, next_type, says): what each branch of a decision leads to, in words."""
    to = nodes.select("doc_id", F.col("node_id").alias("next_id"), F.col("node_type").alias("next_type"), "action", "label")
    says = F.when(F.col("next_type") == "decision", "Continue to next step.").when(F.col("next_type") == "action", F.coalesce("action", F.lit("Action."))).when(F.col("next_type") == "end", F.coalesce("label", F.lit("End."))).otherwise("Continue.")
    return workflow_edges(nodes).withColumnsRenamed({"src": "node_id", "dst": "next_id"}).join(to, ["doc_id", "next_id"], "left").select("doc_id", "node_id", "branch", "next_id", "next_type", says.alias("says"))


def ordered_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("node_id")))


def conditions(nodes: DataFrame, inputs: DataFrame) -> DataFrame:
    """(doc_id, node_id, input_id, expected, name): decisions with the input that their condition names."""
    parsed = nodes.where("node_type = 'decision'").select("doc_id", "node_id", T.parse_condition(F.col("condition")).alias("p"))
    named = parsed.select("doc_id", "node_id", F.col("p.input_id").alias("input_id"), F.col("p.expected").alias("expected"))
    return named.join(inputs.select("doc_id", "input_id", "name"), ["doc_id", "input_id"], "left").select("doc_id", "node_id", "input_id", "expected", "name")


def tolerant_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes under the names used here, whichever of their known names they bear: the first that is neither null nor empty counts."""
    named = {"node_id": ("node_id", "id"), "node_type": ("kind", "node_type", "type"), "action": ("action", "text"), "label": ("label", "text")}
    default = {"node_id": "unknown", "node_type": "unknown"}
    have = {c: tuple(x for x in names if x in nodes.columns) for c, names in named.items()}
    value = lambda c: F.coalesce(*[F.when(F.col(x) != "", F.col(x)) for x in have[c]], F.lit(default.get(c)).cast("string")).alias(c)
    none = lambda c, kind: (F.col(c) if c in nodes.columns else F.lit(None)).cast(kind).alias(c)
    texts = [none(c, "string") for c in ("condition", "true_next", "false_next")]
    return nodes.select("doc_id", value("node_id"), value("node_type"), *texts, value("action"), value("label"), none("requires_human_review", "boolean"), none("citations", f"array<{CITATION}>"))


# The keys that a workflow, its inputs and its nodes may have.
WORKFLOW_KEYS = ("workflow_id", "guideline_id", "inputs", "nodes", "start_node_id", "requires_human_review", "warnings", "meta")
INPUT_KEYS = ("input_id", "name", "type", "description", "choices")
NODE_KEYS = {
    "decision": ("node_id", "node_type", "condition", "true_next", "false_next", "citations"),
    "action": ("node_id", "node_type", "action", "requires_human_review", "citations"),
    "end": ("node_id", "node_type", "label"),
}


def workflow_json(headers: DataFrame, inputs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, json): each workflow as it is written out, inputs and nodes by id, each node with the keys of its kind."""
    inside = inputs.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*[c for c in INPUT_KEYS if c in inputs.columns]))).alias("inputs"))
    body = F.lit(None).cast("string")
    for kind, keys in NODE_KEYS.items():
        body = F.when(F.col("node_type") == kind, F.to_json(F.struct(*keys))).otherwise(body)
    texts = nodes.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("node_id", body.alias("json")))).alias("n"))
    rows = headers.join(inside, "doc_id", "left").join(texts, "doc_id", "left")
    rest = F.to_json(F.struct(*[c for c in WORKFLOW_KEYS if c in rows.columns]))
    listed = F.array_join(F.transform("n", lambda x: x["json"]), ",")
    return rows.select("doc_id", F.concat(F.regexp_replace(rest, r"\}$", ""), F.lit(',"nodes":['), F.coalesce(listed, F.lit("")), F.lit("]}")).alias("json"))


def key_violations(workflows: DataFrame, id_col: str = "doc_id", json_col: str = "json") -> DataFrame:
    """(id, entity, rule, detail) of workflows as JSON: unreadable, without a node, or with keys that they, an input or a node may not have."""
    maps = lambda path: F.from_json(F.get_json_object(json_col, path), "array<map<string,string>>")
    others = lambda keys, known: F.array_join(F.array_sort(F.array_except(keys, F.array(*map(F.lit, known)))), ",")
    rows = T.once(workflows, m=F.from_json(F.col(json_col), "map<string,string>"), i=maps("$.inputs"), n=maps("$.nodes"))
    get = lambda m, k: F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(""))

    def bad(entity: Column, rule: Column, detail: Column) -> Column:
        return F.struct(entity.alias("entity"), rule.alias("rule"), detail.alias("detail"))

    def of_node(x: Column) -> Column:
        detail = F.lit("")
        for kind, keys in NODE_KEYS.items():
            detail = F.when(get(x, "node_type") == kind, others(F.map_keys(x), keys)).otherwise(detail)
        return bad(get(x, "node_id"), F.lit("unknown_key"), detail)

    top = bad(F.lit("workflow"), F.lit("unknown_key"), others(F.map_keys("m"), WORKFLOW_KEYS))
    inputs = F.transform("i", lambda x: bad(get(x, "input_id"), F.lit("unknown_key"), others(F.map_keys(x), INPUT_KEYS)))
    none = F.array().cast("array<struct<entity:string,rule:string,detail:string>>")
    found = F.concat(F.array(top), F.coalesce(inputs, none), F.coalesce(F.transform("n", of_node), none))
    wrong = F.filter(found, lambda x: x["detail"] != "")
    state = F.when(F.col("m").isNull(), F.array(bad(F.lit("workflow"), F.lit("unreadable"), F.lit("")))).when(F.coalesce(F.size("n"), F.lit(0)) <= 0, F.concat(wrong, F.array(bad(F.lit("workflow"), F.lit("no_nodes"), F.lit(""))))).otherwise(wrong)
    return rows.select(id_col, F.inline(state))


# Shapes of ids and kinds of inputs.
NODE_ID, INPUT_ID, INPUT_TYPES = {"decision": r"^d[0-9]{4}$", "action": r"^a[0-9]{4}$", "end": r"^e[0-9]{4}$"}, r"^in[0-9]{3}$", ("bool", "int", "float", "str", "choice")


def shape_violations(nodes: DataFrame, inputs: DataFrame) -> DataFrame:
    """(doc_id, entity, rule): nodes and inputs that are not what their kind must be."""
    kind, text = F.col("node_type"), lambda c: F.coalesce(F.length(c), F.lit(0)) == 0
    wrong_id = F.lit(False)
    for k, pattern in NODE_ID.items():
        wrong_id |= (kind == k) & ~F.coalesce(F.col("node_id").rlike(pattern), F.lit(False))
    node_rules = F.array_compact(
        F.array(
            F.when(~F.coalesce(kind.isin(*NODE_ID), F.lit(False)), "node_type"),
            F.when(wrong_id, "node_id"),
            F.when((kind == "decision") & text("condition"), "condition"),
            F.when((kind == "decision") & (text("true_next") | text("false_next")), "next"),
            F.when((kind == "action") & text("action"), "action"),
        )
    )
    input_rules = F.array_compact(
        F.array(
            F.when(~F.coalesce(F.col("input_id").rlike(INPUT_ID), F.lit(False)), "input_id"),
            F.when(text("name"), "name"),
            F.when(~F.coalesce(F.col("type").isin(*INPUT_TYPES), F.lit(False)), "type"),
        )
    )
    a = nodes.select("doc_id", F.col("node_id").alias("entity"), F.explode(node_rules).alias("rule"))
    return a.unionByName(inputs.select("doc_id", F.col("input_id").alias("entity"), F.explode(input_rules).alias("rule")))
