"""Problem 5: separate the main body of a page from its furniture by a minimum cut.

Every line of a section is a node. A classifier gives each line its evidence in bits; it becomes the capacity of the
edge to the terminal that speaks for it. Smoothness edges join lines that stand next to each other, weaker across a
blank line (another block of the page) and stronger between siblings (the same marker or the same bare shape). The
minimum cut between the terminals labels the lines.

Two facts keep that cheap and exact. A node whose terminal outweighs all its smoothness edges keeps its terminal's side
in every minimum cut, so it is settled at once and its edges become terminal capacity of its neighbours; that is
repeated until nothing changes. Only what is left goes to the max-flow solver, and sections are independent of each
other, so nothing is shuffled.

The classifier is a logistic regression over features of a line: how much likelier its words and sentences are in html
files than in files that hold no page furniture (pdf), counted over all sections of both, and its shape. Its weights are
fitted on a bounded sample of lines, in which lines of pdf files are main body, and so are html lines of a form that only
notices have (label lines, rows, entries with numbers, sentences about bids); what the other html lines are is found by
expectation maximisation, which starts from html against pdf.
"""

from __future__ import annotations

import math
import operator
import re
from bisect import bisect_left
from collections import Counter, deque
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tendrel.llm.arrowtext import by_batch

#: Of so many texts a word or sentence counts once for every time that the thresholds of the line model ask for, at least
#: once: so what passes is bounded by the length of a text, whatever the number of texts.
RARE = 40_000
#: Sections of each format of whose lines the classifier is fitted, chosen by the hash of their key.
SAMPLE = 4_000
#: Rounds of expectation maximisation, and the ridge of the regression.
ROUNDS, RIDGE = 8, 1.0
#: Times that a sentence must be in html files, and never in plain ones, to speak for furniture: less can be chance.
TELLING = 10
#: The most bits that a line's evidence has.
MOST = 12.0
#: Different words and sentences that a task counts before it passes its counts on.
COUNTED = 200_000
#: Different lines whose evidence a task remembers, the last used ones.
SEEN = 100_000
#: The most characters of names and addresses of site owners that go to every executor.
OWNERS = 50_000_000
#: Bits of smoothness: neighbours in one block, neighbours across a blank line, next but one, siblings, and the head of a
#: table with its first row.
NEXT, APART, SECOND, SIBLING, TABLE = 1.0, 0.3, 0.2, 2.0, 12.0

# Words by which a page speaks to its reader or of its owner.
ADDRESS = (
    "you your yours we our us i my welcome thank thanks vous votre nos notre nous ihr ihre wir unser uns usted su nuestro "
    "você seu nosso"
).split()
# Words of the notices themselves.
NOTICE = (
    "bid bids bidder bidders offer offers proposal contract contractor vendor vendor’s supplier owner clause section award "
    "price prices invoice invoices delivery item items bond warranty addendum subcontractors specification software payment "
    "schedule quantity opened licitador contrato oferta ofertas angebot angebote bieter auftragnehmer offre offres "
    "fournisseur titulaire wykonawca oferty zamawiającego contratada fornecedor edital поставщик заявки договора"
).split()
_WORD = re.compile(r"[^\W\d_]+(?:[-’'][^\W\d_]+)*")
_ENTRY = re.compile(r"^(?:[-*•–]|\(?\d{1,3}[.)])\s+\S")
# A row begins with its number and a word: a mere list of numbers leads to other pages.
_ADDRESS, _NOTICE = frozenset(ADDRESS), frozenset(NOTICE)
_ROW = re.compile(r"^\d+\s*\|\s*[^\W\d]")
_LABEL = re.compile(r"^[^\W\d_][\w’' /-]{1,28}:\s+\S")
_STOP = re.compile(r"[.!?]['\"”’)\]]*$")
_MARKS = re.compile(r"\s[|·•/>]\s|\S {3,}\S|[▾▼►▶➤↑☰★☆©«»\[\]←→✉☎]|↓|\s\|\s")
_DIGITS = re.compile(r"\d+")
_NAME = re.compile(r"(?: [A-ZÀ-ÖØ-ÞА-Я][\w’-]*)+")
_SENTENCES = re.compile(r"(?<=[.!?])\s+")
# Cheap signs that a dearer pattern may match: a sentence that goes on, an identifier, a mark.
_GOES_ON, _DASHED, _MARKS_OF = re.compile(r"[.!?]\s"), re.compile(r"-\d"), frozenset("|·•/>▾▼►▶➤↑☰★☆©«»[]←→✉☎↓")
_AMOUNT = re.compile(r"[£€$\d](?:[\d.,:]*\d)?")
# Signs behind a text that was cut off.
_CUT = re.compile(r"\s*(?:\[(?:…|\.\.\.)\]|…|\.\.+|>>|\((?:more|continued)\)|see more(?: description)?)$", re.I)
_CUT_ENDS = ("]", "…", "..", ">>", "more)", "continued)", "more", "description")
_IDENTIFIER = re.compile(r"\b[A-Z]{1,4}-\d[\d-]*")


def pattern(sentence: str) -> str:
    """A sentence with numbers and all names but at its start masked: equal for fillings of one phrase."""
    sentence = sentence.strip()
    if _DIGITS.search(sentence):
        if _DASHED.search(sentence):
            sentence = _IDENTIFIER.sub("9", sentence)
        sentence = _AMOUNT.sub("9", sentence)
    return _NAME.sub(" X", sentence)


def lead(line: str) -> str:
    """The lead of a label line (`Posted` of `Posted: June 9`), in lower case; empty for other lines."""
    return line[: line.index(":")].lower() if _LABEL.match(line) and not marks_in(line) else ""


def sentences(line: str) -> list[str]:
    return _SENTENCES.split(line) if _GOES_ON.search(line) else [line]


def without_identifiers(line: str) -> str:
    return _IDENTIFIER.sub("", line) if _DASHED.search(line) else line


def marks_in(line: str) -> int:
    """Marks of navigation in a line."""
    return 0 if _MARKS_OF.isdisjoint(line) and "   " not in line else len(_MARKS.findall(line))


def begin(words: list[str]) -> str:
    """How a line begins, as an entry among the words."""
    return "^" + " ".join(words[:2])


def counted(text: str) -> tuple[list[str], set[str], list[tuple[str, bool]]]:
    """The words of every line and how it begins, each once a line; the sentence patterns of all lines but the last, which may be cut off;
    and the leads of label lines, each with whether another label line stands next to it."""
    lines = [x.strip() for x in text.split("\n")]
    words: list[str] = []
    for line in lines:
        if own := _WORD.findall(without_identifiers(line).lower()):
            words += {*own, begin(own)}
    leads = [lead(x) if ":" in x else "" for x in lines]
    beside = zip(leads, ["", *leads], [*leads[1:], ""], strict=False)
    whole = [x for x in lines if x][:-1]
    return words, {pattern(s) for x in whole for s in sentences(x)}, [(own, bool(up or down)) for own, up, down in beside if own]


def least(times: int, texts: float) -> float:
    """The threshold of `times` among so many texts, a share of them where they are many."""
    return times * max(1.0, texts / RARE)


#: Features of a line.
FEATURES = 34


class Counts:
    """How often words and sentences occur in (plain, mixed) texts, and leads of label lines (plain, mixed alone, mixed beside
    another)."""

    def __init__(self) -> None:
        self.words, self.patterns = (Counter(), Counter()), (Counter(), Counter())
        self.leads = (Counter(), Counter(), Counter())
        self.totals, self.sizes = [0, 0], [0, 0]

    def add(self, kind: int, text: str) -> None:
        words, patterns, leads = counted(text)
        self.sizes[kind] += 1
        self.totals[kind] += len(words)
        self.words[kind].update(words)
        self.patterns[kind].update(patterns)
        for own, beside in leads:
            self.leads[kind + (kind and beside)][own] += 1

    def __len__(self) -> int:
        return sum(map(len, (*self.words, *self.patterns, *self.leads)))


def _log_odds(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.clip(rows @ weights, -30.0, 30.0)


def _regression(rows: np.ndarray, wanted: np.ndarray, times: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression with a ridge, by Newton's method from given ones."""
    for _ in range(25):
        p = 1 / (1 + np.exp(-_log_odds(weights, rows)))
        slope = rows.T @ (times * (p - wanted)) + RIDGE * weights
        step = np.linalg.solve((rows * (times * p * (1 - p))[:, None]).T @ rows + RIDGE * np.eye(rows.shape[1]), slope)
        weights = weights - step
        if np.abs(step).max() < 1e-4:
            break
    return weights


class LineModel:
    """Evidence, in bits, that a line is furniture (positive) or main body (negative)."""

    def __init__(self, words: dict[str, float], known: set[str], foreign: set[str], labels: set[str], spoken: set[str], names: list[str], theta: list[float] | None = None):
        self.words, self.known, self.foreign, self.labels, self.spoken, self.theta = words, known, foreign, labels, spoken, theta
        #: Names by their first word, so that a line costs the same whatever their number.
        self.names: dict[str, tuple[str, ...]] = {}
        for name in dict.fromkeys(names):
            if m := _WORD.search(name):
                self.names[m.group()] = (*self.names.get(m.group(), ()), name[m.start() :])
        # What a line says rests on the line alone, never on its place or on other lines.
        self._of_line = lru_cache(SEEN)(self._bits)

    @classmethod
    def fit(cls, plain: Iterable[str], mixed: Iterable[str], names: list[str]) -> LineModel:
        """Fitted on texts without and with furniture; `names` are the names and addresses of the sites' owners."""
        counts = Counts()
        texts = [list(plain), list(mixed)]
        for k, own in enumerate(texts):
            for text in own:
                counts.add(k, text)
        return cls.of_counts(counts, names).fitted(*texts)

    @classmethod
    def of_counts(cls, counts: Counts, names: list[str]) -> LineModel:
        """What the counts of words, sentences and leads say; without weights yet."""
        sizes, (m, n) = counts.sizes, (counts.totals[0] + 1, counts.totals[1] + 1)
        once, twice, thrice = least(1, sizes[0]), least(2, sizes[0]), least(3, sum(sizes) / 2)
        (plain, mixed), (known, other), (spoken, alone, beside) = counts.words, counts.patterns, counts.leads
        every = {w: (plain[w], mixed[w]) for w in plain | mixed}
        words = {w: max(-2.0, min(6.0, math.log2((b + 0.5) / n * m / (a + 0.5)))) for w, (a, b) in every.items() if a + b >= thrice or a >= twice}
        foreign = {s for s, b in other.items() if b >= least(TELLING, sizes[1]) and known[s] < once}
        # A lead is a label of the notice if it mostly stands beside other label lines, as in the head of a notice.
        labels = {x for x, n in beside.items() if n > alone[x] and n >= least(3, sizes[1])}
        own = {s for s, a in known.items() if a >= twice}
        return cls(words, own, foreign, labels, {x for x, a in spoken.items() if a >= twice}, names)

    def fitted(self, plain: list[str], mixed: list[str]) -> LineModel:
        """This model with weights fitted on the lines of a sample of texts without and with furniture."""
        lines = [Counter(s for t in texts for x in t.split("\n") if (s := x.strip())) for texts in (plain, mixed)]
        every = sorted(lines[0] | lines[1])
        rows = np.array([self.features(x) for x in every] or [[0.0] * FEATURES])
        times = np.array([lines[0][x] + lines[1][x] for x in every] or [1], float)
        main = np.array([x in lines[0] or self.of_notice(x) for x in every] or [True])
        scale = np.maximum(rows.std(0), 1e-3)
        rows = rows / scale
        weights = _regression(rows, (~main).astype(float), times, np.zeros(rows.shape[1]))
        for _ in range(ROUNDS):
            share = np.where(main, 0.0, 1 / (1 + np.exp(-_log_odds(weights, rows))))
            weights = _regression(rows, share, times, weights)
        return LineModel(self.words, self.known, self.foreign, self.labels, self.spoken, self.owners(), (weights / scale / math.log(2)).tolist())

    def owners(self) -> list[str]:
        return [name for group in self.names.values() for name in group]

    def of_notice(self, line: str) -> bool:
        """Whether a line has a form that only notices have."""
        marked, words = _MARKS.search(line), _WORD.findall(line.lower())
        if lead(line) in self.labels or _ROW.match(line):
            return True
        if _ENTRY.match(line):
            return not marked and bool(re.search(r"\d", line[3:]))
        told = any(w in _NOTICE for w in words) and not any(w in _ADDRESS for w in words)
        return bool(told and not marked and len(words) >= 5 and _STOP.search(line))

    def bits(self, line: str) -> float:
        """Evidence of one line, from its text alone."""
        return self._of_line(line.strip())

    def owned(self, line: str, words: list[str] | None = None) -> bool:
        """Whether a line (of these words) holds the name or address of an owner, beginning at a word."""
        if self.names.keys().isdisjoint(_WORD.findall(line) if words is None else words):
            return False
        return any(line.startswith(name, m.start()) for m in _WORD.finditer(line) for name in self.names.get(m.group(), ()))

    def features(self, line: str) -> list[float]:
        """What the regression weighs: a constant, length, words by their log ratios, sentences, shape, and owner."""
        if line[-12:].lower().endswith(_CUT_ENDS):
            line = _CUT.sub("", line)
        spelt = _WORD.findall(without_identifiers(line))
        words = [w.lower() for w in spelt]
        n, get = len(words), self.words.get
        ratios = sorted([x for w in words if (x := get(w)) is not None])
        unknown, per = n - len(ratios), 1 / max(n, 1)
        told_of = [pattern(s) for s in sentences(line)]
        known = len([s for s in told_of if s in self.known]) / len(told_of)
        foreign = len([s for s in told_of if s in self.foreign]) / len(told_of)
        told, address = len([w for w in words if w in _NOTICE]), len([w for w in words if w in _ADDRESS])
        marks, leads = min(marks_in(line), 3), lead(line) if ":" in line else ""
        stop, first = bool(_STOP.search(line, max(0, len(line) - 8))), line[:1]
        return [
            1.0, min(n, 30) / 10, n == 0, n <= 2, n <= 5, n >= 9,
            max(sum(ratios[: bisect_left(ratios, 0.0)]), -10.0) / 5, ratios[0] if ratios else 0.0, ratios[-1] if ratios else 0.0, sum(ratios) * per,
            unknown * per, min(unknown, 5) / 2, (len(ratios) - bisect_left(ratios, 5.0)) * per,
            get(begin(words), 0.0), known, known == 1, foreign, foreign == 1,
            stop, stop and n >= 5, bool(_ENTRY.match(line)), bool(_ROW.match(line)), leads in self.labels, bool(leads) and leads not in self.labels and leads not in self.spoken,
            marks, self.owned(line, spelt), bool(_DIGITS.search(line)), first.islower(), first.isupper(), ":" in line, "@" in line or "www." in line or "://" in line,
            min(told, 3), min(address, 3), told > 0 and stop,
        ]

    def _bits(self, line: str) -> float:
        value = sum(map(operator.mul, self.theta, self.features(line)))
        return max(-MOST, min(MOST, value))


def _flow_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes lie on the sink's side of the minimum cut: shortest augmenting paths, breadth first."""
    n = len(source)
    s, t = n, n + 1
    graph: list[dict[int, float]] = [{} for _ in range(n + 2)]
    for i in range(n):
        if source[i] > 0:
            graph[s][i], graph[i][s] = source[i], 0.0
        if sink[i] > 0:
            graph[i][t], graph[t][i] = sink[i], 0.0
    for i, j, c in edges:
        graph[i][j] = graph[i].get(j, 0.0) + c
        graph[j][i] = graph[j].get(i, 0.0) + c
    while True:
        came, queue = {s: s}, deque([s])
        while queue and t not in came:
            u = queue.popleft()
            for v, c in graph[u].items():
                if c > 1e-9 and v not in came:
                    came[v] = u
                    queue.append(v)
        if t not in came:
            return [i not in came for i in range(n)]
        path, v = [], t
        while v != s:
            path.append((came[v], v))
            v = came[v]
        push = min(graph[u][v] for u, v in path)
        for u, v in path:
            graph[u][v] -= push
            graph[v][u] += push


def min_cut(bits: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are furniture: the labels of least total cost, ties in favour of the main body.

    bits: evidence for furniture (positive) or main body (negative), the cost of labelling otherwise.
    edges: (i, j, cost of labelling i and j differently).
    """
    n = len(bits)
    value = list(bits)
    label: list[bool | None] = [None] * n
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for i, j, c in edges:
        near[i].append((j, c))
        near[j].append((i, c))
    todo = list(range(n))
    while todo:
        i = todo.pop()
        if label[i] is not None:
            continue
        pull = sum(c for j, c in near[i] if label[j] is None)
        if value[i] > pull or value[i] <= -pull:
            label[i] = value[i] > 0
            for j, c in near[i]:
                if label[j] is None:
                    value[j] += c if label[i] else -c
                    todo.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        at = {i: k for k, i in enumerate(rest)}
        left = [(at[i], at[j], c) for i, j, c in edges if i in at and j in at]
        # Source: main body. A node on the sink's side pays its source edge, the evidence for main body.
        cut = _flow_cut([max(0.0, -value[i]) for i in rest], [max(0.0, value[i]) for i in rest], left)
        reach = _flow_cut([max(0.0, value[i]) for i in rest], [max(0.0, -value[i]) for i in rest], left)
        for k, i in enumerate(rest):
            label[i] = cut[k] and not reach[k]
    return [bool(x) for x in label]


def _form(line: str) -> str:
    """Siblings have the same form: their marker, or being a bare short line."""
    m = re.match(r"([-*•>–]|\(?\d{1,3}[.)])\s", line)
    if m:
        return _DIGITS.sub("9", m.group(1))
    if _ROW.match(line):
        return "|"
    return "bare" if len(line) < 24 and not re.search(r"[.:|!?]", line) else ""


def furniture_lines(text: str, model: LineModel) -> list[int]:
    """Numbers (from 1) of the lines of a section that are page furniture."""
    lines = text.split("\n")
    at = [k for k, line in enumerate(lines) if line.strip()]
    if not at:
        return []
    bits = [model.bits(lines[k]) for k in at]
    if max(bits) <= 0:
        return []  # every node is on the main body's side at no cost
    forms = [_form(lines[k].strip()) for k in at]
    edges = []
    for i in range(len(at) - 1):
        together = at[i + 1] == at[i] + 1
        weight = NEXT if together else APART
        if together and forms[i] and forms[i] == forms[i + 1]:
            weight += SIBLING
        # The head of a table stands over its rows and has as many cells.
        head, row = lines[at[i]], lines[at[i + 1]]
        if "|" in head and not _ROW.match(head) and _ROW.match(row) and head.count("|") == row.count("|"):
            weight += TABLE
        edges.append((i, i + 1, weight))
        if i + 2 < len(at) and at[i + 2] == at[i] + 2:
            edges.append((i, i + 2, SECOND))
    return [at[i] + 1 for i, cut in enumerate(min_cut(bits, edges)) if cut]


_COUNTS = T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "what", "item")] + [T.StructField("n", T.LongType())])


def _partial_counts(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Counts of a task's words, sentences and leads by source_format, passed on whenever they are COUNTED different ones;
    and the texts of the sample."""
    kinds = ("pdf", "html")
    counts = Counts()

    def passed() -> Iterable[pa.RecordBatch]:
        rows: list[tuple[str, str, str, int]] = []
        for what, own in (("word", counts.words), ("pattern", counts.patterns), ("lead", counts.leads[:2])):
            for kind, items in zip(kinds, own, strict=True):
                rows += [(kind, what, item, n) for item, n in items.items()]
        rows += [("html", "beside", item, n) for item, n in counts.leads[2].items()]
        rows += [(kind, "total", "", n) for kind, n in zip(kinds, counts.totals, strict=True) if n]
        if rows:
            yield _counts_batch(rows)

    for batch in batches:
        sampled = []
        for kind, text, chosen in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            counts.add(kinds.index(kind), text)
            if chosen:
                sampled.append((kind, "sample", text, 1))
        if sampled:
            yield _counts_batch(sampled)
        if len(counts) >= COUNTED:
            yield from passed()
            counts = Counts()
    yield from passed()


def _counts_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], _COUNTS.names)


def fit_line_model(sections: DataFrame, names: DataFrame | None = None, key: str = "section_key") -> LineModel:
    """The line model of a corpus: counts over all its pdf and html sections, weights from a bounded sample of their lines.

    Words, sentences and leads are counted in every task, then by groupBy, in one pass over the texts; the driver gets
    those only that pass the thresholds, which are shares of the texts, and the sample of about SAMPLE sections of each
    format, chosen by the hash of their key. names (columns agency_name and site) is a table of site owners, all of which
    are used; its size is measured first, and ValueError raised beyond OWNERS characters.
    """
    rows = sections.where(F.col("text").isNotNull() & F.col("source_format").isin("pdf", "html"))
    found = {r[0]: r[1] for r in rows.groupBy("source_format").count().collect()}
    sizes = [found.get("pdf", 0), found.get("html", 0)]
    share = F.when(F.col("source_format") == "pdf", min(1.0, SAMPLE / max(sizes[0], 1))).otherwise(min(1.0, SAMPLE / max(sizes[1], 1)))
    chosen = F.pmod(F.xxhash64(key), F.lit(1_000_003)) < share * 1_000_003
    partial = rows.select("source_format", "text", chosen.alias("chosen")).mapInArrow(_partial_counts, _COUNTS)
    plain, mixed = (F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(a) for k, a in (("pdf", "a"), ("html", "b")))
    counted = partial.groupBy("what", "item").agg(plain, mixed)
    often = (F.col("a") >= least(2, sizes[0])) | F.col("what").isin("total", "sample")
    told = F.col("what").isin("word", "lead", "beside") & (F.col("a") + F.col("b") >= least(3, sum(sizes) / 2))
    foreign = (F.col("what") == "pattern") & (F.col("b") >= least(TELLING, sizes[1])) & (F.col("a") < least(1, sizes[0]))
    counts = Counts()
    counts.sizes = sizes
    sample: list[list[str]] = [[], []]
    for what, item, a, b in counted.where(often | told | foreign).collect():
        if what == "sample":
            sample[0] += [item] * a
            sample[1] += [item] * b
        elif what == "total":
            counts.totals = [a, b]
        elif what == "beside":
            counts.leads[2][item] = b
        else:
            pair = {"word": counts.words, "pattern": counts.patterns, "lead": counts.leads}[what]
            pair[0][item], pair[1][item] = a, b
    owners: list[str] = []
    if names is not None:
        given = names.select(F.explode(F.array("agency_name", "site")).alias("name")).where("name <> ''").distinct()
        if (given.agg(F.sum(F.length("name"))).first()[0] or 0) > OWNERS:
            raise ValueError(f"the names of the sites' owners have more than {OWNERS} characters")
        owners = sorted(r[0] for r in given.collect())
    return LineModel.of_counts(counts, owners).fitted(*sample)


def _labelled(sections: DataFrame, model: LineModel, key: str, name: str, kind: T.DataType, arrow: pa.DataType, made) -> DataFrame:
    """key and `name`: made(text, numbers of its furniture lines), of every html section with a text."""
    fitted = (model.words, model.known, model.foreign, model.labels, model.spoken, model.owners(), model.theta)
    shared = sections.sparkSession.sparkContext.broadcast(fitted)
    own: list[LineModel] = []
    schema = T.StructType([T.StructField(key, sections.schema[key].dataType), T.StructField(name, kind)])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not own:
            own.append(LineModel(*shared.value))
        values = [made(text, furniture_lines(text, own[0])) for text in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, arrow)], schema.names)

    rows = sections.where((F.col("source_format") == "html") & F.col("text").isNotNull())
    return rows.select(key, "text").mapInArrow(by_batch(run), schema)


def label_lines(sections: DataFrame, model: LineModel, key: str = "section_key") -> DataFrame:
    """key and furniture (array of line numbers, from 1) of every html section with a text; the array may be empty.

    Sections with a null text do not come out; blank lines are counted but never furniture. Repeated rows come out each,
    texts are read whole, other columns are left aside. No shuffle; the model is bounded by its thresholds.
    """
    return _labelled(sections, model, key, "furniture", T.ArrayType(T.IntegerType()), pa.list_(pa.int32()), lambda text, cut: cut)


def main_body(sections: DataFrame, model: LineModel, key: str = "section_key") -> DataFrame:
    """key and body of every html section: the lines that are not furniture; null where nothing of it is left."""

    def body(text: str, cut: list[int]) -> str | None:
        out = set(cut)
        kept = "\n".join(x for k, x in enumerate(text.split("\n"), 1) if k not in out).strip("\n")
        return kept if kept.strip() else None

    return _labelled(sections, model, key, "body", T.StringType(), pa.string(), body)
