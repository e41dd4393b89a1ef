"""Property checks: tokenizer and command-line parsing against
plain Python, decision targets inside [1, cap], the batch fold against a
direct simulation, completed/pending partition of the tasks."""

from hypothesis import given, settings
from hypothesis import strategies as st

from fleetlane.operators import scaling as sc
from fleetlane.operators import tasks as tk
from fleetlane.operators import wordcount as wc

ALPHABET = st.sampled_from(list("ab ZÅ\t\n\r\f\u000b .,"))
TEXTS = st.lists(st.text(ALPHABET, max_size=30), min_size=1, max_size=40)


def _py_tokens(t):
    for ch in "\t\n\r\f":
        t = t.replace(ch, " ")
    return [x for x in t.split(" ") if x]


@settings(max_examples=8, deadline=None)
@given(TEXTS)
def test_tokenizer_matches_python(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.word: r.cnt for r in wc.wordcount(df).collect()}
    exp = {}
    for t in texts:
        for tok in _py_tokens(t):
            exp[tok] = exp.get(tok, 0) + 1
    assert got == exp
    assert sum(got.values()) == sum(len(_py_tokens(t)) for t in texts)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.text(st.sampled_from(list("xy/1-")), min_size=1, max_size=6),
                         max_size=6), min_size=1, max_size=30),
       st.sampled_from([" ", "\t", "  ", " \t "]))
def test_queue_parse_matches_python_split(spark, lines, sep):
    values = [sep + sep.join(toks) + sep for toks in lines]
    df = spark.createDataFrame(list(enumerate(values)), "pos long, value string")
    got = {r.pos: (r.input, r.output, r.uuid) for r in tk.parse_queue(df).collect()}
    exp = {}
    for i, v in enumerate(values):
        toks = v.split()
        if toks:
            exp[i] = (toks[2] if len(toks) > 2 else None, toks[3] if len(toks) > 3 else None, toks[-1])
    assert got == exp


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 6)), min_size=1, max_size=60))
def test_service_policy_target_in_range(spark, pairs):
    df = spark.createDataFrame(pairs, "depth long, groups long")
    for r in sc.service_policy(df, 6).collect():
        assert 1 <= r.target <= 6
        assert (r.action == "extend") == (r.target > r.groups)
        assert (r.action == "shrink") == (r.target < r.groups)


@settings(max_examples=5, deadline=None)
@given(st.sets(st.integers(0, 50), max_size=30), st.lists(st.integers(0, 80), max_size=60))
def test_completed_and_pending_partition_tasks(spark, task_ids, done_ids):
    def u(i):
        return f"{i:08x}-0000-1000-8000-00aa00000000"
    tasks = spark.createDataFrame([(i, u(i), "in") for i in sorted(task_ids)] or [(0, "x", "in")],
                                  "pos long, uuid string, input string")
    lines = spark.createDataFrame([(p, f"{u(i)}:::logs/{i}") for p, i in enumerate(done_ids)]
                                  or [(0, "")], "pos long, value string")
    parsed = tk.parse_completions(lines)
    done = {r.uuid for r in tk.completion_match(tasks, tk.first_completions(parsed)).collect()}
    pend = {r.uuid for r in tk.pending_tasks(tasks, parsed).collect()}
    all_ids = {r.uuid for r in tasks.collect()}
    assert done | pend == all_ids and not (done & pend)
    assert done == all_ids & {u(i) for i in done_ids}
