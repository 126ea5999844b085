"""Spans and tag sequences: offsets to tokens, spans to tags, tags to spans, constrained decoding."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

# The tag set.
OUTSIDE = "PD-pad"
TAGS = [OUTSIDE, "BH-obj", "IH-obj", "BD-obj", "ID-obj", "BH-act", "IH-act", "BD-act", "ID-act", "BH-func", "IH-func", "BH-dis", "IH-dis"]


def token_offsets(sentences: DataFrame, id_col: str = "doc", text_col: str = "sentence") -> DataFrame:
    """doc, pos, token, start, end of white-space tokens."""
    words = F.split(F.col(text_col), " ")
    state = F.aggregate(words, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<token:string,start:int,end:int>>").alias("out")), lambda s, w: F.struct((s["at"] + F.length(w) + 1).alias("at"), F.concat(s["out"], F.array(F.struct(w.alias("token"), s["at"].alias("start"), (s["at"] + F.length(w)).alias("end")))).alias("out")), lambda s: s["out"])
    rows = sentences.select(F.col(id_col).alias("doc"), F.posexplode(F.filter(state, lambda x: x["token"] != "")).alias("pos", "t"))
    return rows.select("doc", "pos", "t.token", "t.start", "t.end")


def to_token_indices(spans: DataFrame, tokens: DataFrame) -> DataFrame:
    """spans(doc, span_id, start, end) with first and last token; an offset that is no token's edge gives null."""
    first = tokens.select("doc", F.col("start"), F.col("pos").alias("first"))
    last = tokens.select("doc", F.col("end"), F.col("pos").alias("last"))
    return spans.join(first, ["doc", "start"], "left").join(last, ["doc", "end"], "left")


def spans_to_tags(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """doc, tags: one tag per token; spans(doc, type, ss, se, es, ee) in token positions (es, ee null: contiguous).

    The first token of a span is BH, the rest IH; the second half of a discontiguous span BD, ID; where spans overlap,
    the one that ends last wins.
    """
    part = lambda a, b, head, rest: F.transform(F.sequence(F.col(a), F.col(b)), lambda i: F.struct(i.cast("int").alias("pos"), F.concat(F.when(i == F.col(a), head).otherwise(rest), F.lit("-"), F.col("type")).alias("tag")))
    end = F.coalesce("ee", "se")
    first = spans.filter("ss <= se").select("doc", end.alias("end"), F.explode(part("ss", "se", "BH", "IH")).alias("x"))
    second = spans.filter("es <= ee").select("doc", end.alias("end"), F.explode(part("es", "ee", "BD", "ID")).alias("x"))
    best = first.union(second).groupBy("doc", "x.pos").agg(F.max_by("x.tag", F.struct("end", "x.tag")).alias("tag"))
    tagged = tokens.select("doc", "pos").join(best, ["doc", "pos"], "left").select("doc", "pos", F.coalesce("tag", F.lit(OUTSIDE)).alias("tag"))
    return tagged.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tag"))), lambda x: x["tag"]).alias("tags"))


def tags_to_spans(tagged: DataFrame, key: str = "doc", ignore: tuple[str, ...] = ()) -> DataFrame:
    """key, type, start, end (inclusive) of typed runs in tags array: gaps and islands.

    BH and BD open a span; IH and ID continue one of their type, else open one.
    """
    x = tagged.select(key, F.posexplode("tags").alias("pos", "tag")).select(key, "pos", F.substring("tag", 1, 2).alias("head"), F.expr("substring(tag, 4)").alias("type"))
    x = x.withColumn("type", F.when((F.col("head") != "PD") & ~F.col("type").isin(*ignore) if ignore else F.col("head") != "PD", F.col("type")))
    w = Window.partitionBy(key).orderBy("pos")
    opens = F.col("head").isin("BH", "BD") | ~F.col("type").eqNullSafe(F.lag("type").over(w))
    x = x.withColumn("n", F.sum(F.when(opens, 1).otherwise(0)).over(w)).filter("type is not null")
    return x.groupBy(key, "n", "type").agg(F.min("pos").alias("start"), F.max("pos").alias("end")).drop("n")


def assemble_discontiguous(tagged: DataFrame, kind: str, mode: str = "intended") -> DataFrame:
    """doc, words, ss, se, es, ee of the spans of one kind in tagged(doc, words, tags); compat: a row per doc, see _folded.

    intended: runs of the kind are read in order, and each can be a head, one that starts with IH or ID or a BD run that
    stands alone as well.  A BD run takes the run before it, also one that it touches; after that no run can be taken
    until a BH run begins anew.  `positions` has all places of a span; es and ee (its second half) are null without one.
    compat: what the surveyed system does.  A BD takes the last stored head only, so a head that it touches is stored by
    itself, or lost where another one is stored already; of equal heads the latest goes; a span that ends the sentence is
    lost.  Missing indices are -1 as long as fill_indices has not filled them.

    Rows without a doc stand together; null words or tags give no spans.
    """
    if mode == "compat":
        return tagged.select("doc", F.explode(_folded(F.col("words"), F.col("tags"), kind)).alias("s")).select("doc", "s.*")
    if mode != "intended":
        raise ValueError(mode)
    x = tagged.select("doc", F.posexplode(F.arrays_zip("words", "tags")).alias("pos", "t")).select("doc", "pos", F.col("t.words").alias("word"), F.substring("t.tags", 1, 2).alias("head"), F.expr("substring(t.tags, 4)").alias("type"))
    w = Window.partitionBy("doc").orderBy("pos")
    x = x.withColumn("own", F.col("type") == kind)
    opens = F.col("head").isin("BH", "BD") | ~F.coalesce(F.lag("own").over(w), F.lit(False))
    runs = x.withColumn("n", F.sum(F.when(F.col("own") & opens, 1).otherwise(0)).over(w)).filter("own")
    runs = runs.groupBy("doc", "n").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("t"), F.min_by("head", "pos").alias("head"))
    v = Window.partitionBy("doc").orderBy("n")
    runs = runs.withColumn("anew", F.sum(F.when(F.col("head") == "BH", 1).otherwise(0)).over(v)).withColumn("half", (F.col("head") == "BD") & F.lag("n").over(v).isNotNull())
    halves = F.sum(F.when(F.col("half"), 1).otherwise(0)).over(Window.partitionBy("doc", "anew").orderBy("n"))
    runs = runs.withColumn("takes", F.col("half") & (halves == 1))
    runs = runs.withColumn("span", F.sum(F.when(F.col("takes"), 0).otherwise(1)).over(v))
    joined = runs.groupBy("doc", "span").agg(F.array_sort(F.collect_list(F.struct("n", "t"))).alias("runs"))
    first, second = F.col("runs")[0]["t"], F.when(F.size("runs") > 1, F.element_at("runs", -1)["t"])
    places = F.flatten(F.transform("runs", lambda r: r["t"]))
    edge = lambda t, i: F.element_at(t, i)["pos"]
    return joined.select("doc", F.transform(places, lambda p: p["word"]).alias("words"), F.transform(places, lambda p: p["pos"]).alias("positions"), edge(first, 1).alias("ss"), edge(first, -1).alias("se"), edge(second, 1).alias("es"), edge(second, -1).alias("ee"))


_PLACES = "struct<id:int,ss:int,se:int,es:int,ee:int>"
_STATE = f"struct<spans:array<array<string>>,places:array<{_PLACES}>,words:array<string>,place:{_PLACES},head:array<string>,head_place:{_PLACES},taken:array<string>>"


def _without_last(items: Column, found: Column) -> Column:
    """items without the last element for which found (an array of booleans beside it) holds; as they are if none does."""
    back = F.array_position(F.reverse(found), True).cast("int")
    n = F.size(items)
    return F.when(back > 0, F.concat(F.slice(items, 1, n - back), F.slice(items, n - back + 2, n))).otherwise(items)


def _folded(words: Column, tags: Column, kind: str) -> Column:
    """array<struct<words, ss, se, es, ee>>: the spans of a kind, by a state machine along the tags."""
    place = lambda i, ss=-1, se=-1, es=-1, ee=-1: F.struct(*(x.cast("int").alias(n) for n, x in zip(("id", "ss", "se", "es", "ee"), (i, *(F.lit(v) if isinstance(v, int) else v for v in (ss, se, es, ee))), strict=True)))
    none = F.array().cast("array<string>")
    order = ("spans", "places", "words", "place", "head", "head_place", "taken")

    def state(s: Column | None = None, **new: Column) -> Column:
        return F.struct(*((new[n] if n in new else s[n]).alias(n) for n in order)).cast(_STATE)

    def put(p: Column, **new: Column) -> Column:
        return F.struct(*((new[n].cast("int") if n in new else p[n]).alias(n) for n in ("id", "ss", "se", "es", "ee")))

    def stored(s: Column, head: bool | Column = True, **new: Column) -> Column:
        """The current span among the spans; it becomes the head that a second half can take."""
        keep = F.lit(head) if isinstance(head, bool) else head
        kept = {"spans": F.concat(s["spans"], F.array(s["words"])), "places": F.concat(s["places"], F.array(s["place"])), "head": F.when(keep, s["words"]).otherwise(s["head"]), "head_place": F.when(keep, s["place"]).otherwise(s["head_place"])}
        return state(s, **(kept | new))

    def step(s: Column, t: Column) -> Column:
        i, word, some = t["pos"], F.array(t["word"]), F.size(s["words"]) > 0
        blank = {"words": none, "place": place(-1 - i)}
        other = F.when(some, stored(s, F.size(s["taken"]) == 0, **blank)).otherwise(state(s, **blank))
        anew = {"words": word, "place": place(i, i)}
        begin = F.when(some, stored(s, taken=none, **anew)).otherwise(state(s, taken=none, **anew))
        more = F.concat(s["words"], word)
        inside = state(s, words=more, place=F.when(s["place"]["es"] == -1, put(s["place"], se=i)).otherwise(put(s["place"], ee=i)))
        behind = state(s, words=more, place=put(s["place"], ee=i))
        equal = F.transform(s["spans"], lambda x: x == s["head"])
        takes = (s["taken"] != s["head"]) & F.array_contains(equal, True)
        own = F.transform(s["places"], lambda p: p["id"] == s["head_place"]["id"])
        taken = state(s, spans=_without_last(s["spans"], equal), places=_without_last(s["places"], own), taken=s["head"], words=F.concat(s["head"], word), place=put(s["head_place"], es=i), head=none)
        half = F.when(takes, taken).when(some, stored(s, **anew)).otherwise(state(s, **anew))
        return F.when(~F.coalesce(t["type"] == kind, F.lit(False)), other).when(t["head"] == "BH", begin).when(t["head"] == "IH", inside).when(t["head"] == "BD", half).otherwise(behind)

    rows = F.transform(F.arrays_zip(words.alias("w"), tags.alias("t")), lambda x, i: F.struct(i.alias("pos"), x["w"].alias("word"), F.substring(x["t"], 1, 2).alias("head"), F.substring(x["t"], 4, 100).alias("type")))
    first = state(spans=F.array().cast("array<array<string>>"), places=F.array().cast(f"array<{_PLACES}>"), words=none, place=place(F.lit(-(1 << 20))), head=none, head_place=place(F.lit(-(1 << 20))), taken=none)
    last = F.aggregate(rows, first, step)
    both = F.arrays_zip(last["spans"].alias("words"), last["places"].alias("places"))
    return F.transform(both, lambda b: F.struct(b["words"].alias("words"), *(b["places"][n].alias(n) for n in ("ss", "se", "es", "ee"))))


def fill_indices(ss: Column, se: Column, es: Column, ee: Column) -> Column:
    """Missing (-1) parts of four span indices filled from the one before."""
    gap = lambda a, b: F.when(a == -1, b).otherwise(a)
    e1 = gap(se, ss)
    s2 = gap(es, e1)
    return F.struct(ss.alias("ss"), e1.alias("se"), s2.alias("es"), gap(ee, s2).alias("ee"))


def allowed() -> np.ndarray:
    """allowed[i, j]: whether tag j may follow tag i; the last row is the start, the last column the end."""
    n = len(TAGS)
    ok = np.zeros((n + 1, n + 1), bool)
    split = [(t[:2], t[3:]) for t in TAGS]
    ok[n, 0] = True
    for i, (head, kind) in enumerate(split):
        for j, (h2, k2) in enumerate(split):
            if head == "PD":
                ok[i, j] = h2 == "BH"
            else:
                ok[i, j] = h2 in ("BH", "BD", "PD") or (h2 in ("IH", "ID") and k2 == kind)
        ok[i, n] = head == "PD"
    return ok


#: What a transition that is not allowed costs; a path that needs one is none.
NEVER = -1e12


def best_path(scores: Column, transitions: np.ndarray) -> Column:
    """array<int>: the states of the best path for scores (array of arrays: tokens by states), null where there is none.

    transitions[i, j] is added from state i to j, the last row and column are the start and the end; NEVER or less is not
    allowed.  A dynamic programme along the tokens: each step keeps, for every state, the best score and from where it
    came; equal scores go to the smaller state.  Null or empty scores give an empty path.
    """
    n = len(transitions) - 1
    weight = np.maximum(np.nan_to_num(transitions, neginf=NEVER), NEVER)

    def into(best: Column, j: int) -> Column:
        """The best (score, -state) to come from: an array's largest struct."""
        return F.array_max(F.array(*(F.struct((best[i] + F.lit(float(weight[i, j]))).alias("score"), F.lit(-i).alias("at")) for i in range(n))))

    def step(state: Column, row: Column) -> Column:
        came = F.array(*(into(state["best"], j) for j in range(n)))
        moved = lambda c: F.struct(F.zip_with(c["came"], row, lambda a, x: a["score"] + x).alias("best"), F.concat(state["back"], F.array(F.transform(c["came"], lambda a: -a["at"]))).alias("back"))
        return F.transform(F.array(F.struct(came.alias("came"))), moved)[0]

    opening = F.zip_with(F.array(*(F.lit(float(x)) for x in weight[n, :n])), F.element_at(scores, 1).cast("array<double>"), lambda a, b: a + b)
    first = F.struct(opening.alias("best"), F.array().cast("array<array<int>>").alias("back"))
    done = F.aggregate(F.slice(scores, 2, F.size(scores)).cast("array<array<double>>"), first, step)

    def walked(s: Column) -> Column:
        last = into(s["best"], n)
        start = F.struct((-last["at"]).alias("at"), F.array(-last["at"]).alias("path"))
        back = F.aggregate(F.reverse(s["back"]), start, lambda t, b: F.struct(F.get(b, t["at"]).alias("at"), F.concat(F.array(F.get(b, t["at"])), t["path"]).alias("path")))
        return F.when(last["score"] > F.lit(NEVER / 2), back["path"])

    return F.when(F.coalesce(F.size(scores), F.lit(0)) <= 0, F.array().cast("array<int>")).otherwise(F.transform(F.array(done), walked)[0])


def constraints() -> np.ndarray:
    """The allowed transitions of the tag set as weights."""
    return np.where(allowed(), 0.0, NEVER)


def decode(rows: DataFrame, key: str = "doc", scores: str = "scores", transitions: np.ndarray | None = None, tags: list[str] | None = None) -> DataFrame:
    """key, tags: the best allowed tag sequence for an array of score arrays (tokens by tags) per row.

    Where no allowed sequence exists every token is outside; null scores give no tags.
    """
    names = F.array(*map(F.lit, tags or TAGS))
    path = best_path(F.col(scores), constraints() if transitions is None else transitions)
    outside = F.transform(F.coalesce(F.col(scores), F.array()), lambda _: F.lit(OUTSIDE))
    return rows.select(F.col(key).cast("string").alias(key), F.coalesce(F.transform(path, lambda i: F.element_at(names, i + 1)), outside).alias("tags"))


# A tagger that learns: a hidden Markov model.  Scores are whole thousandths of natural logarithms, so sums are exact.


def _parts(word: Column) -> Column:
    """What is counted for a word: itself, and its last three letters for words that were not seen."""
    lower = F.lower(word)
    return F.array(F.struct(F.lit("word").alias("kind"), lower.alias("value")), F.struct(F.lit("end").alias("kind"), F.right(lower, F.lit(3)).alias("value")))


def hmm_counts(tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kind, value, tag, n) of words and word ends, and (a, b, n) of neighbouring tags with start ^ and end $.

    tagged: words, tags; rows without words count as nothing.
    """
    rows = tagged.filter("size(words) > 0 and size(tags) = size(words)")
    pairs = rows.select(F.explode(F.arrays_zip("words", "tags")).alias("p")).select(F.explode(_parts(F.col("p.words"))).alias("x"), F.col("p.tags").alias("tag"))
    held = pairs.groupBy("x.kind", "x.value", "tag").agg(F.count("*").alias("n"))
    steps = rows.select(F.explode(F.arrays_zip(F.concat(F.array(F.lit("^")), "tags").alias("a"), F.concat("tags", F.array(F.lit("$"))).alias("b"))).alias("p"))
    return held, steps.groupBy("p.a", "p.b").agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class Tagger:
    """tags, their transitions, and scores by kind and value: kind, value, scores (array, a place per tag)."""

    tags: list[str]
    transitions: np.ndarray
    emissions: DataFrame

    def scored(self, sentences: DataFrame) -> DataFrame:
        """doc, words, scores of sentences(doc, words): of the word, else of its end, else 0 for every tag."""
        rows = sentences.select("doc", F.posexplode("words").alias("pos", "word")).withColumn("value", F.lower("word"))
        table = self.emissions.select("kind", "value", "scores")
        words = table.filter("kind = 'word'").select("value", F.col("scores").alias("own"))
        ends = table.filter("kind = 'end'").select(F.col("value").alias("last"), F.col("scores").alias("end_scores"))
        # Distinct words meet the tables, so a very common one is looked up once.
        known = rows.select("value").distinct().withColumn("last", F.right("value", F.lit(3))).join(words, "value", "left").join(ends, "last", "left")
        zero = F.array(*(F.lit(0.0) for _ in self.tags))
        looked = materialise(known.select("value", F.coalesce("own", "end_scores", zero).alias("scores")), "scores")
        both = rows.join(looked, "value").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("pos", "word", "scores"))).alias("x"))
        return both.select("doc", F.transform("x", lambda t: t["word"]).alias("words"), F.transform("x", lambda t: t["scores"]).alias("scores"))

    def tag(self, sentences: DataFrame) -> DataFrame:
        """doc, words, tags of sentences(doc, words); docs must differ.  Sentences without words do not come out."""
        x = self.scored(sentences)
        path = best_path(F.col("scores"), self.transitions)
        names = F.array(*map(F.lit, self.tags))
        outside = F.transform("words", lambda _: F.lit(OUTSIDE))
        return x.select("doc", "words", F.coalesce(F.transform(path, lambda i: F.element_at(names, i + 1)), outside).alias("tags"))


def _log(share: Column) -> Column:
    return F.round(F.log(share) * 1000)


def learn(tagged: DataFrame) -> Tagger:
    """A tagger from tagged(words, tags): the counts are aggregations, the driver reads those of tag pairs alone.

    A transition that was never seen is not allowed.  A word's score for a tag is the logarithm of how much more often it
    has that tag than words at large have; shares of words are drawn to those of their ends, these to those of all words.
    """
    held, steps = hmm_counts(tagged)
    held = materialise(held, "emissions")
    seen = {(r.a, r.b): r.n for r in steps.collect()}  # at most the tags' number, squared
    tags = sorted({a for a, _ in seen if a != "^"} | {b for _, b in seen if b != "$"}, key=lambda t: (t != OUTSIDE, t)) or [OUTSIDE]
    states, places = [*tags, "^"], [*tags, "$"]
    out = {a: sum(n for (x, _), n in seen.items() if x == a) for a in states}
    weights = np.array([[round(1000 * math.log(seen[a, b] / out[a])) if seen.get((a, b)) else NEVER for b in places] for a in states], float).reshape(len(states), -1)
    count = {t: out.get(t, 0) for t in tags}
    total = max(1, sum(count.values()))
    share = F.array(*(F.lit(count[t] / total) for t in tags))
    vector = lambda m: F.array(*(F.coalesce(F.try_element_at(m, F.lit(t)), F.lit(0)).cast("double") for t in tags))
    rows = held.groupBy("kind", "value").agg(F.map_from_entries(F.collect_list(F.struct("tag", "n"))).alias("m"), F.sum("n").cast("double").alias("all")).select("kind", "value", vector(F.col("m")).alias("n"), "all")
    drawn = lambda prior: F.zip_with("n", prior, lambda n, p: (n + p) / (F.col("all") + 1))
    ends = rows.filter("kind = 'end'").select("value", drawn(share).alias("p"))
    words = rows.filter("kind = 'word'").join(ends.select(F.col("value").alias("last"), F.col("p").alias("prior")), F.right("value", F.lit(3)) == F.col("last")).select("kind", "value", drawn(F.col("prior")).alias("p"))
    every = words.unionByName(ends.select(F.lit("end").alias("kind"), "value", "p"))
    emissions = every.select("kind", "value", F.zip_with("p", share, lambda p, q: _log(p) - _log(q)).alias("scores"))
    return Tagger(tags, weights, materialise(emissions, "scores"))


def rule_tags(sentences: DataFrame, id_col: str = "doc", text_col: str = "sentence") -> DataFrame:
    """The default tagger, without a model: words of five or more letters are objects, all else is outside."""
    rows = sentences.select(F.col(id_col).alias("doc"), F.split(F.col(text_col), " ").alias("words"))
    inside = F.transform("words", lambda w: F.length(F.regexp_replace(w, r"[^\p{L}]", "")) >= 5)
    # Arrays are columns of their own: an expression within a function of elements would run once for each of them.
    rows = rows.select("doc", "words", inside.alias("inside"))
    rows = rows.select("doc", "words", "inside", F.concat(F.array(F.lit(False)), "inside").alias("before"))
    tags = F.zip_with("inside", F.slice("before", 1, F.size("inside")), lambda here, before: F.when(here & before, "IH-obj").when(here, "BH-obj").otherwise(OUTSIDE))
    return rows.select("doc", "words", tags.alias("tags"))
