"""Personal data: fixed base spans, and candidates selected by gradient boosting.

Base spans are exact patterns with their checks.  Beside them, generators
propose overlapping candidate spans with high recall; boosted trees score
every candidate by format (length, digits, groups, check sums) and context
(cue words before it, neighbouring characters).  Scores are calibrated on held
out rows, and each kind has the threshold that keeps ``PRECISION`` there.
Selected candidates that touch no base span and no better candidate are added.

The trees learn from ``TRAINING_ROWS`` generated rows, a fixed number with a
fixed seed: no corpus text and no column of the documents enters.
"""

from __future__ import annotations

import random
import re
import string
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stipendia.llm.boosting import BoostedTrees

KINDS = ("email", "ip", "card", "phone", "id", "secret")  # the order of spans; the first four have base patterns
TRAINING_ROWS = 6_000
PRECISION = 0.98

# --- base spans --------------------------------------------------------------------------------------------------

_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match can only start where a run of digits starts: the lookbehind spares long runs a retry at each digit.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]")


def luhn(digits: str) -> bool:
    doubled = [int(c) * 2 for c in digits[-2::-2]]
    return (sum(int(c) for c in digits[::-2]) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def _emails(text: str):
    """Leftmost matches, found from each @: the local part is the run before it, not reaching into the last match."""
    end, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        start = at
        if domain:
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                end = domain.end()
                yield start, end
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the base patterns, leftmost without overlap per kind, failing matches dropped."""
    found = [(0, s, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in m[0].split(".")):
            found.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            found.append((3, *m.span()))
    return found


# --- candidates --------------------------------------------------------------------------------------------------

# Each names the kind it proposes; bounded repeats keep the time in proportion to the text.  Secrets end where their
# characters end: one class up to a boundary is linear without a bound.
GENERATORS = (
    (0, re.compile(r"[\w.+-]{1,64} ?(?:@|\(at\)|\[at\]) ?[\w-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]) ?[\w-]{1,63}){1,6}")),
    (1, re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")),
    (2, re.compile(r"(?<![0-9])[0-9]{4}(?:[ ./_-]?[0-9]{2,6}){2,5}(?![0-9])")),
    (3, re.compile(r"(?<![0-9A-Za-z])[(]?[0-9]{2,5}[)]?(?:[ ./()-]{1,2}[0-9]{2,8}){1,5}(?![0-9])")),
    (4, re.compile(r"(?<![0-9A-Za-z])(?:[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}|[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?)(?![0-9A-Za-z])")),
    (5, re.compile(r"(?<![0-9A-Za-z])[A-Z]{3,5}[0-9A-Z]{12,}(?![0-9A-Za-z])")),
    (5, re.compile(r"(?i)(?<![a-z])(?:password|passwd|pwd|token|secret|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?[^\s\"']{6,}")),
)
_SIGN = re.compile("[0-9@]")
_AT_WORDS, _SECRET_WORDS = ("(at)", "[at]"), ("passw", "pwd", "token", "secret", "api_key", "api-key", "apikey")
_CUES = tuple(re.compile(p, re.I) for p in (
    r"mail|contact|write to", r"\bip\b|address|host", r"card|visa|payment|credit", r"phone|call|tel|mobile|fax|cell",
    r"ssn|social|iban|account|passport", r"password|token|secret|key|login",
    r"isbn|issn|page|version|order|invoice|figure|since|from|between|date|sum|total|id\b|no\.|commit|model|part"))
CONTEXT = 24


def _iban(value: str) -> bool:
    packed = value.replace(" ", "")
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[0-9A-Z]{11,30}", packed):
        return False
    return int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    value, before, after = text[start:end], text[max(0, start - CONTEXT):start], text[end:end + 2]
    digits = _NOT_DIGIT.sub("", value)
    groups = re.findall(r"[0-9]+", value)
    secret = re.split(r"[=:]", value, maxsplit=1)[-1].strip(" \"'")
    kinds_of = sum(bool(re.search(p, secret)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    dates = any(len(g) == 4 and g[:2] in ("19", "20") for g in groups) and len(digits) <= 10
    return [
        kind, len(value), len(digits), len(digits) / len(value), len(groups), max(map(len, groups), default=0),
        min(map(len, groups), default=0), len(groups[0]) if groups else 0, len(groups[-1]) if groups else 0,
        len(set(secret)) / max(1, len(secret)), kinds_of, len(secret), float(bool(digits) and luhn(digits)), float(_iban(value)),
        float("@" in value), value.count("."), value.count(":"), value.count("-"), value.count(" "), float("(" in value),
        float(dates), float(value[:4] == "AKIA"), float(bool(re.search(r"\.[A-Za-z]{2,}$", value))),
        float(before[-1:] not in ("", " ", "\n", "\t")), float(after[:1].isalnum() or after[:1] in "_/%$€"),
        float(before[-1:] in "#$€v"), *[float(bool(c.search(before))) for c in _CUES],
    ]


# --- training rows -------------------------------------------------------------------------------------------------

_FILLER = "the and of for was with report after before der und les que para near total value line item see".split()


def _example(rng: random.Random) -> tuple[int, str, str, str, int]:
    """(kind, context before, value, context after, label): a likely or an unlikely instance of a kind."""
    kind, good = rng.randrange(6), rng.random() < 0.5
    digit = lambda n: "".join(rng.choice(string.digits) for _ in range(n))
    word = lambda: "".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(3, 9)))
    text = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    cue, other = "", ""
    if kind == 0:
        value = (f"{word()}.{word()} {rng.choice(['(at)', '[at]'])} {word()} {rng.choice(['(dot)', '[dot]', '.'])} com" if good else
                 rng.choice([f"{word()} @ {rng.randint(1, 99)}.{digit(2)}", f"{word()} @{word()} .{word()}", f"{word()} @ {word()}. {word()}"]))
        cue, other = rng.choice(["mail ", "contact: ", "write to ", ""]), rng.choice(["price ", "since ", ""])
    elif kind == 1:
        value = (":".join(text(rng.randint(1, 4), "0123456789abcdef") for _ in range(8)) if good else
                 rng.choice([f"{rng.randint(0, 23):02}:{rng.randint(0, 59):02}:{digit(2)}", f"{digit(1)}:{digit(2)}:{digit(2)}", "::1"]))
        cue, other = rng.choice(["ip ", "host ", "address ", ""]), rng.choice(["at ", "from ", "date ", ""])
    elif kind == 2:
        body = rng.choice("3456") + digit(14)
        check = next(c for c in string.digits if luhn(body + c))
        number = body + (check if good else rng.choice([c for c in string.digits if c != check]))
        gap = rng.choice([".", "_", "/"]) if good else rng.choice(["", " ", "-", "."])
        value = gap.join(number[i:i + 4] for i in range(0, 16, 4))
        cue, other = rng.choice(["card ", "visa ", "payment ", ""]), rng.choice(["order ", "id ", "invoice no. ", ""])
    elif kind == 3:
        value = (rng.choice([f"({digit(3)}) {digit(3)}-{digit(4)}", f"{digit(3)}-{digit(3)}-{digit(4)}", f"0{digit(2)} {digit(3)} {digit(4)}",
                             f"00{digit(2)} {digit(3)} {digit(7)}", f"{digit(3)}.{digit(3)}.{digit(4)}"]) if good else
                 rng.choice([f"{rng.choice(['19', '20'])}{digit(2)}-{rng.choice(['19', '20'])}{digit(2)}", f"20{digit(2)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}",
                             f"978-{digit(1)}-{digit(2)}-{digit(6)}", f"{digit(2)}.{digit(3)}.{digit(3)}", f"{digit(2)} {digit(2)}", f"{digit(3)}-{digit(3)}",
                             f"{digit(2)}/{digit(2)}/20{digit(2)}", f"{digit(4)} {digit(4)}", f"{digit(2)} {digit(3)} {digit(2)}"]))
        cue = rng.choice(["phone ", "call ", "tel. ", "mobile: "]) if good and "(" not in value else rng.choice(["phone ", ""])
        other = rng.choice(["isbn ", "page ", "between ", "version ", "", ""])
    elif kind == 4:
        if rng.random() < 0.5:
            value = f"{digit(3)}-{digit(2)}-{digit(4)}" if good else f"{digit(3)} {digit(2)} {digit(4)}"
            cue, other = rng.choice(["ssn ", "social security "]), rng.choice(["part ", "model ", "sum ", ""])
        else:
            rest = digit(18)
            check = 98 - int(rest + str(int("D", 36)) + str(int("E", 36)) + "00") % 97
            value = f"DE{check if good else (check + rng.randint(1, 60)) % 97:02}{rest}"
            value = value if rng.random() < 0.5 else " ".join(value[i:i + 4] for i in range(0, len(value), 4))
            cue, other = rng.choice(["iban ", "account ", ""]), rng.choice(["model ", "part ", "order ", ""])
    else:
        if rng.random() < 0.5:
            value = "AKIA" + text(16, string.ascii_uppercase + "234567") if good else text(rng.randint(15, 30), string.ascii_uppercase)
            cue, other = rng.choice(["key ", "", ""]), rng.choice(["", "model "])
        else:
            name = rng.choice(["password", "token", "secret", "api_key"])
            value = (f"{name}{rng.choice(['=', ': ', ' = ' + chr(34)])}{text(rng.randint(12, 40), '0123456789abcdef')}" if good else
                     f"{name}{rng.choice(['=', ': ', ' = '])}{rng.choice([word() + word(), 'required', 'forgotten', 'expired', '<yours>', 'example'])}")
    lead = " ".join(rng.choice(_FILLER) for _ in range(3)) + " "
    tail = rng.choice([" ", ".", ",", "\n"]) + rng.choice(_FILLER)
    return kind, lead + (cue if good else other), value, tail, int(good)


@dataclass(frozen=True)
class Selector:
    trees: BoostedTrees
    slope: float
    shift: float
    limits: tuple[float, ...]

    def chances(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.trees.raw(rows) + self.shift)))


@lru_cache(maxsize=2)
def train(rows: int = TRAINING_ROWS, precision: float = PRECISION, seed: int = 7) -> Selector:
    """Three quarters of the rows grow the trees; on the rest their scores are calibrated and each kind's limit is set."""
    rng = random.Random(seed)
    made = [_example(rng) for _ in range(rows)]
    x = np.array([features(b + v + a, k, len(b), len(b) + len(v)) for k, b, v, a, _ in made])
    y = np.array([m[4] for m in made], float)
    held = np.arange(rows) % 4 == 3
    trees = BoostedTrees().fit(x[~held], y[~held])
    raw, slope, shift = trees.raw(x[held]), 1.0, 0.0
    for _ in range(50):  # Newton steps of a one-variable logistic fit, slightly damped
        p = 1 / (1 + np.exp(-(slope * raw + shift)))
        g, w = y[held] - p, p * (1 - p) + 1e-6
        a, b, c = (w * raw * raw).sum() + 1, (w * raw).sum(), w.sum() + 1e-3
        d = a * c - b * b
        slope, shift = slope + ((g * raw).sum() * c - g.sum() * b - c * (slope - 1)) / d, shift + (g.sum() * a - (g * raw).sum() * b) / d
    chance = 1 / (1 + np.exp(-(slope * raw + shift)))
    limits = []
    for kind in range(len(KINDS)):
        mine = x[held][:, 0] == kind
        order = np.argsort(-chance[mine], kind="stable")
        right = np.cumsum(y[held][mine][order]) / np.arange(1, mine.sum() + 1)
        good = np.flatnonzero(right >= precision)
        limits.append(max(0.5, float(chance[mine][order][good[-1]])) if len(good) else 1.0)
    return Selector(trees, slope, shift, tuple(limits))


def hints(text: str) -> tuple[bool, bool, bool]:
    """Whether the text has a digit or an @; what an address needs; what a named secret needs."""
    low = text.lower()
    return (_SIGN.search(text) is not None, "@" in text or any(w in low for w in _AT_WORDS), any(w in low for w in _SECRET_WORDS))


def candidates(text: str, hinted: tuple[bool, bool, bool] | None = None) -> list[tuple[int, int, int]]:
    sign, address, secret = hinted or hints(text)
    needed = (address, ":" in text, sign, sign, sign, sign, secret)
    return [(kind, *m.span()) for (kind, pattern), use in zip(GENERATORS, needed) if use for m in pattern.finditer(text)]


def added_spans(text: str, base: list[tuple[int, int, int]], selector: Selector,
                hinted: tuple[bool, bool, bool] | None = None) -> list[tuple[int, int, int]]:
    """Candidates above their kind's limit, best first, that overlap nothing taken before."""
    proposed = candidates(text, hinted)
    if not proposed:
        return []
    chance = selector.chances(np.array([features(text, *c) for c in proposed]))
    blocked, out = np.zeros(len(text), bool), []
    for _, start, end in base:
        blocked[start:end] = True
    for _, (kind, start, end) in sorted((-p, c) for p, c in zip(chance.tolist(), proposed) if p >= selector.limits[c[0]]):
        if not blocked[start:end].any():
            blocked[start:end] = True
            out.append((kind, start, end))
    return out


def find(text: str | None, selector: Selector) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans), both by kind, then start."""
    hinted = hints(text) if text else (False, False, False)
    if not any(hinted) and not (text and ":" in text):
        return [], []
    base = sorted(base_spans(text)) if hinted[0] else []
    return base, sorted(base + added_spans(text, base, selector, hinted))


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Every stretch of overlapping spans becomes the tag of its first kind."""
    out, at = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e in spans):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_redacted: bool = True,
                  carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base, spans[, redacted], carried columns) of every row.

    Counts and ``base`` are of the base spans; ``spans`` has all; both are kind:start:end in code points, joined by
    commas.  Null and empty texts have none (redacted: null stays null); repeated rows are answered each; columns not
    named in ``carry`` are not read.
    """
    selector = train()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)])

    def run(batches):
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            base_of, all_of, clean = [], [], []
            for value in batch.column(1):
                text = value.as_py()
                base, spans = find(text, selector)
                for kind in range(4):
                    counts[kind].append(sum(k == kind for k, _, _ in base))
                base_of.append(named(base))
                all_of.append(named(spans))
                clean.append(redact(text, spans) if spans else text)
            columns = [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(base_of, pa.string()), pa.array(all_of, pa.string())]
            if with_redacted:
                columns.append(pa.array(clean, pa.string()))
            yield pa.RecordBatch.from_arrays([*columns, *batch.columns[2:]], names=names)

    added = ["n_email", "n_ip", "n_card", "n_phone", "base", "spans"] + ["redacted"] * with_redacted
    names = ["id", *added, *source.columns[2:]]
    kinds = [dict(source.dtypes)["id"], *["bigint"] * 4, *["string"] * (len(added) - 4), *[t for _, t in source.dtypes[2:]]]
    out = source.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in zip(names, kinds)))
    return out.toDF(id_col, *added, *carry)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")
