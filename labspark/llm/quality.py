"""Line-first cleaning: rules per line, then reject documents that lose too much text.

Three rules look at each line of a text (\\n-split): punctuation (a line of prose that neither ends nor
goes on in the next line, or words that carry marks), navigation (menu separators, or menu words alone) and boilerplate
(phrases of licences, cookie and copyright notices in four languages, or mostly the same word again and again). Failing
lines are removed; a document stays if what remains is a large enough share of its word characters. Repetition and
length (the base rule) come before that.

Headings and list items need no sentence end: lines of fewer than LEAST_WORDS words and lines that begin with a bullet
or a number pass. So does a line whose next line begins with a small letter, as in wrapped text, and the only line of a text.
Sentence ends are those of all scripts.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least share of the word characters that the lines kept must hold.
LEAST_KEPT = 0.5
#: Phrases of boilerplate lines, in lower case; where a letter with an accent follows, the phrase ends before it.
BOILERPLATE = [
    "all rights reserved", "licensed under", "is licensed under", "released under the", "terms of use",
    "terms of service", "privacy policy", "cookie policy", "use of cookies", "we use cookies",
    "enable javascript", "javascript is disabled", "lorem ipsum", "click here", "subscribe to our newsletter",
    "skip to content", "skip to main content", "share this",
    "alle rechte vorbehalten", "datenschutzerkl", "nutzungsbedingungen", "verwendet cookies", "verwenden cookies",
    "cookie-richtlinie", "newsletter abonnieren", "javascript aktivieren", "zum inhalt springen", "hier klicken",
    "lizenziert unter",
    "tous droits r", "politique de confidentialit", "conditions d'utilisation", "utilise des cookies",
    "utilisons des cookies", "activer javascript", "aller au contenu", "cliquez ici", "abonnez-vous", "sous licence",
    "todos los derechos reservados", "de privacidad", "utiliza cookies", "utilizamos cookies", "usamos cookies",
    "ir al contenido", "haga clic", "haz clic", "bajo licencia", "bajo la licencia"]
#: Menu entries, in lower case but for letters with an accent, which stand in both cases.
MENU_WORDS = [
    "home", "menu", "login", "log in", "sign in", "sign up", "register", "search", "next", "previous",
    "back to top", "contact us", "about us", "read more", "sitemap",
    "startseite", "menü", "anmelden", "registrieren", "suche", "weiter", "zurück", "datenschutz", "impressum", "kontakt",
    "über uns", "Über uns", "mehr lesen", "nach oben",
    "accueil", "connexion", "rechercher", "suivant", "précédent", "contactez-nous", "à propos", "À propos",
    "lire la suite", "plan du site", "haut de page",
    "inicio", "menú", "iniciar sesión", "buscar", "siguiente", "anterior", "contacto", "sobre nosotros", "leer más",
    "mapa del sitio", "volver arriba"]
#: A line of at most this many words, half of them (two at least) menu entries of one word, is a menu.
MENU_LINE = 8
#: A line with at least this many separators, and at least one for every three words, is a menu or a table row.
LEAST_SEPARATORS = 3
#: A line of at least this many words must end a sentence or be continued; shorter ones may be headings.
LEAST_WORDS = 12
#: Share of a line's words that may carry two or more equal marks or be shouted with !!.
MOST_MARKED = 0.3

_SEPARATORS = re.compile(rb"(?:^|[ \t])(?:\||>|>>|/|\xc2\xbb|\xe2\x80\xba|\xc2\xb7|\xe2\x80\xa2)(?=[ \t]|$)")
_MARKED = re.compile(rb"([!?#*$%&|<>=_~^])\1+[.,;:]?(?=[ \t]|$)")
_BOILERPLATE = re.compile("|".join(re.escape(p) for p in BOILERPLATE).encode())
_MENU = re.compile(rb"[ \t]*(?:" + "|".join(re.escape(w) for w in MENU_WORDS).encode() + rb")[ \t]*[:.>]*[ \t]*")
_MENU_TOKENS = frozenset(w.encode() for w in MENU_WORDS if " " not in w)
_ITEM = re.compile(r"[ \t]*(?:[-*+•·‣–—]|\(?[0-9]{1,3}[.)]|\(?[A-Za-z][.)])[ \t]".encode())
#: With what a line may end: sentence ends of all scripts, closing marks, and marks after which a sentence goes on.
ENDS = frozenset(c for c in map(chr, range(0x20000)) if regex.match(r"\p{Sentence_Terminal}", c)) | frozenset(
    "\"')]}…”’»›」』）】》:;,：；，、")
_SYMBOLS = b"#*$%&|<>"
_BLANKS = b" \t\n\x0b\x0c\r"


def failed_rule(line: bytes, following: bytes | None = b"", alone: bool = False) -> str | None:
    """The rule that a line fails: punctuation, navigation or boilerplate; None for a good or blank line.

    ``following`` is the next line (None after the last one); ``alone`` says that no other line has words.
    """
    words = line.split()
    if not words:
        return None
    lower = line.lower()
    if _BOILERPLATE.search(lower):
        return "boilerplate"
    if b"|" in line or b">" in line or b"/" in line or b"\xc2" in line or b"\xe2" in line:
        separators = len(_SEPARATORS.findall(line))
        if separators >= LEAST_SEPARATORS and 3 * separators >= len(words) - separators:
            return "navigation"
    if len(words) <= MENU_LINE:
        if len(words) <= 4 and _MENU.fullmatch(lower.strip(b"\r")):
            return "navigation"
        entries = sum(w.rstrip(b":.>,|") in _MENU_TOKENS for w in lower.split())
        if entries >= 2 and 2 * entries >= len(words):
            return "navigation"
    if len(words) >= 10 and 2 * sum(map(bytes.__eq__, words, words[1:])) > len(words):
        return "boilerplate"
    if len(_MARKED.findall(line)) > MOST_MARKED * len(words):
        return "punctuation"
    if len(words) >= LEAST_WORDS and not alone and words[-1].decode("utf-8", "surrogatepass")[-1] not in ENDS:
        start = (following or b"").split(None, 1)[:1]
        continued = start and unicodedata.category(start[0].decode("utf-8", "surrogatepass")[0]) == "Ll"
        if not continued and not _ITEM.match(line):
            return "punctuation"
    return None


def repeated_words(words: list[bytes], window: int = 8) -> int:
    """Words inside windows that occur twice or more in the text, the first occurrence included. Exact.

    Ranks of 1, 2, 4 and 8 words: each length's ranks come from pairs of ranks of half the length.
    """
    if len(words) <= window:
        return 0
    known: dict[bytes, int] = {}
    ranks = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(known) == len(words):
        return 0
    step = 1
    while step < window:
        pairs = ranks[:-step] * np.int64(len(words) + 1) + ranks[step:]
        order = np.argsort(pairs, kind="stable")
        fresh = np.empty(len(pairs), bool)
        fresh[0] = False
        fresh[1:] = np.diff(pairs[order]) != 0
        ranks = np.empty(len(pairs), np.int64)
        ranks[order] = np.cumsum(fresh)
        step *= 2
        if ranks.max() == len(ranks) - 1:
            return 0  # all different: so are longer windows
    counts = np.bincount(ranks)
    starts = np.flatnonzero(counts[ranks] > 1)
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + window, -1)
    return int((np.cumsum(covered[:-1]) > 0).sum())


def measure(text: str) -> tuple:
    """All figures of one text, in the order of FIELDS after the kept columns."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    in_words = sum(map(len, words))
    word_chars = len(text) - (len(raw) - in_words)
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = raw.split(b"\n")
    seen: set[bytes] = set()
    duplicates, kept_bytes = 0, 0
    failures = {"punctuation": 0, "navigation": 0, "boilerplate": 0}
    kept_lines = []
    sizes = [sum(map(len, line.split())) for line in lines]
    alone = sum(size > 0 for size in sizes) == 1
    for line, held, following in zip(lines, sizes, [*lines[1:], None], strict=True):
        if held and line in seen:
            duplicates += 1
        seen.add(line)
        rule = failed_rule(line, following, alone)
        if rule:
            failures[rule] += 1
        else:
            kept_bytes += held
            kept_lines.append(line)
    repeated = repeated_words(words)
    base_failed = len(words) < 20 or 100 * repeated > 30 * len(words)
    share = kept_bytes / in_words if in_words else 0.0
    return (len(words), word_chars, symbols, duplicates, repeated, base_failed,
            not base_failed and share >= LEAST_KEPT, share, failures["punctuation"], failures["navigation"],
            failures["boilerplate"], b"\n".join(kept_lines).decode("utf-8", "surrogatepass"))


FIGURES = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
           ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("kept_share", pa.float64()),
           ("n_bad_punctuation", pa.int64()), ("n_navigation", pa.int64()), ("n_boilerplate", pa.int64()),
           ("clean_text", pa.string())]
SQL_TYPES = {pa.int64(): "long", pa.bool_(): "boolean", pa.float64(): "double", pa.string(): "string"}


def assess(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Per row: doc_id, the base figures, kept, the share of word bytes in good lines, failed lines per rule.

    ``docs`` has doc_id and text (others are left out). A null or empty text has no words: it fails
    the base rule. ``with_text`` adds ``clean_text``, the lines that passed. One pass over each text, no
    shuffle; repeated rows get equal figures; no rows, no result.
    """
    figures = [f for f in FIGURES if with_text or f[0] != "clean_text"]
    key_type = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t.as_py() or "") for t in batch.column(1)]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in FIGURES]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, kind) for c, (_, kind) in zip(columns, figures, strict=False)]],
                ["doc_id", *[n for n, _ in figures]])

    schema = f"doc_id {key_type}, " + ", ".join(f"{n} {SQL_TYPES[kind]}" for n, kind in figures)
    return docs.select("doc_id", "text").mapInArrow(work, schema)


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, without their failing lines, with all columns, in place (no join, no shuffle).

    A document without failing lines keeps its text as it is; of another one ``n_chars``, if there is such a
    column, follows the text.
    """
    schema = docs.schema
    at = docs.columns.index("text")
    counted = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(t.as_py() or "") for t in batch.column(at)]
            kept = pa.array([f[6] for f in found], pa.bool_())
            clean = [f[-1] if f[6] and any(f[8:11]) else None for f in found]
            columns = list(batch.columns)
            columns[at] = pc.coalesce(pa.array(clean, columns[at].type), columns[at])
            if counted is not None:
                sizes = pa.array([None if c is None else len(c) for c in clean], pa.int64())
                columns[counted] = pc.coalesce(sizes.cast(columns[counted].type), columns[counted])
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names).filter(kept)

    return docs.mapInArrow(work, schema)


def explain(docs: DataFrame) -> DataFrame:
    """Counts of rejected and kept documents by base rule and method."""
    return assess(docs).groupBy("base_failed", "kept").agg(F.count(F.lit(1)).alias("documents"))
