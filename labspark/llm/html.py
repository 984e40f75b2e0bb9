"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: runs of text between the tags of block elements. Each block has features of
its ancestors (tags, words of class, id and role) and of its text (length, link share, punctuation, cue
words). A CRF with the labels main and other scores blocks and neighbouring labels; Viterbi finds the best labelling.
It is trained on labelled pages that ``labelled_pages`` writes: some page layouts with known roles.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Labelled pages for training and gradient steps of the fit.
PAGES = 600
STEPS = 200
MAIN, OTHER = "\ue001", "\ue000"

BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption"
    " figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup html iframe legend li main menu nav ol"
    " optgroup option p pre search section select summary table tbody td tfoot th thead tr ul video audio".split())
EMPTY_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page; formulas stay, their source annotations go.
RAW_TAGS = frozenset("script style noscript template title textarea iframe svg annotation annotation-xml noembed".split())
#: Tags that end an open element of the listed kinds.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table article section div main body nav aside form header footer".split())
CUES = frozenset(
    "copyright rights reserved cookie cookies privacy terms subscribe newsletter login register comment comments reply"
    " replies share related advertisement sponsored menu home search posted".split())

REGIONS = frozenset("article main nav header footer aside form section".split())

#: Open elements kept track of; deeper ones count as siblings.
DEEPEST = 100

# Quotes count only after "="; an unquoted value holds them. Nothing is tried twice, so a tag is read in one pass.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|))*+)>""")
# For a page where a tag would run to the end: its tags end at the next ">" whatever the quotes say.
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I | re.S)
_NAME = re.compile(r"[a-z]+")


def leaf_blocks(page: str) -> list[tuple[str, tuple, int]]:
    """(text, ancestors, characters within links) of every leaf block with text; ancestors are (tag, names).

    One pass from "<" to "<". A comment or declaration without an end hides the rest of the page; a "<" that begins no
    tag is text.
    """
    out: list[tuple[str, tuple, int]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked, links, at = 0, 0, 0

    def end_block() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((text, tuple(stack), linked))
            parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        text = entities.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if links:
            linked += len(text.strip())

    n, pattern = len(page), _TAG
    last = page.rfind(">")
    while at < n:
        start = page.find("<", at)
        if start < 0 or start > last and not page.startswith(("<!", "<?"), start):
            add(page[at:])
            break
        if start > at:
            add(page[at:start])
        if page.startswith(("<!", "<?"), start):
            end = page.find("-->", start + 4) + 2 if page.startswith("<!--", start) else page.find(">", start)
            at = end + 1 if end > start else n
            continue
        letter = page[start + 2:start + 3] if page.startswith("</", start) else page[start + 1:start + 2]
        if not (letter.isascii() and letter.isalpha()):
            add("<")
            at = start + 1
            continue
        found = pattern.match(page, start)
        if found is None:
            pattern = _PLAIN_TAG
            found = pattern.match(page, start)
        if found is None:
            add("<")
            at = start + 1
            continue
        at = found.end()
        tag = found[2].lower()
        if found[1]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCK_TAGS:
                end_block()
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
            continue
        if tag in RAW_TAGS:
            if tag != "svg" or not found[3].endswith("/"):
                close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = close.end() if close else n
            continue
        if tag in EMPTY_TAGS:
            if tag == "hr":
                end_block()
            else:
                parts.append(" ")
        elif tag == "a":
            links += 1
        elif tag in BLOCK_TAGS:
            end_block()
            ends = CLOSES.get(tag)
            for i in range(len(stack) - 1, -1, -1):
                above = stack[i][0]
                if above == "p" or ends and above in ends:
                    del stack[i:]
                    break
                if above in SCOPES:
                    break
            names = ()
            if found[3]:
                names = tuple(w for m in _ATTRIBUTE.finditer(found[3])
                              for w in _NAME.findall((m[2] or m[3] or m[4] or "").lower()))
            if len(stack) >= DEEPEST:
                stack.pop()
            stack.append((tag, names))
            links = 0
    end_block()
    return out


def _ancestor_features(stack: tuple) -> list[str]:
    tags = [t for t, _ in stack if t not in ("html", "body")]
    found = {f"in:{t}" for t in tags} | {f"name:{w}" for _, names in stack for w in names}
    found.add(f"parent:{tags[-1] if tags else 'body'}")
    # the innermost element that tells something decides more often than the outer ones
    found |= {f"near:{w}" for w in next((names for _, names in reversed(stack) if names), ())}
    found.add("region:" + next((t for t in reversed(tags) if t in REGIONS), "none"))
    within = next((i for i, (t, _) in enumerate(stack) if t in ("article", "main")), None)
    if within is not None:
        inner = stack[within + 1:]
        found |= {f"inner:{w}" for _, names in inner for w in names} | {f"inner-in:{t}" for t, _ in inner}
    if not {"article", "main"} & set(tags):
        found.add("no-article")
    return sorted(found)


def _text_features(text: str, linked: int) -> list[str]:
    words = text.split()
    found = [f"words:{min(len(words), 64).bit_length()}", f"linked:{min(4, 5 * linked // max(1, len(text)))}",
             "ends" if text[-1] in ".!?…。\"”»" else "open"]
    if len(words) <= 40:
        found += [f"cue:{w}" for w in {x.strip(".,:;!?()").lower() for x in words} & CUES]
    if "©" in text:
        found.append("copyright-sign")
    return found


class Tagger:
    """Weights of the field: emissions (feature x label), transitions and starts."""

    def __init__(self, vocabulary: dict[str, int], weights: np.ndarray, moves: np.ndarray, starts: np.ndarray):
        self.vocabulary, self.weights, self.moves, self.starts = vocabulary, weights, moves, starts
        self._stacks: dict[tuple, np.ndarray] = {}

    def emissions(self, blocks: list[tuple[str, tuple, int]]) -> np.ndarray:
        scores = np.empty((len(blocks), 2))
        for i, (text, stack, linked) in enumerate(blocks):
            base = self._stacks.get(stack)
            if base is None:
                base = self._sum(_ancestor_features(stack))
                if len(self._stacks) < 10_000:  # a cache only
                    self._stacks[stack] = base
            scores[i] = base + self._sum(_text_features(text, linked))
        return scores

    def _sum(self, features: list[str]) -> np.ndarray:
        known = [self.vocabulary[f] for f in features if f in self.vocabulary]
        return self.weights[known].sum(0)

    def labels(self, blocks: list[tuple[str, tuple, int]]) -> list[int]:
        """Viterbi: the labelling (1 is main) with the largest score."""
        if not blocks:
            return []
        (a00, a01), (a10, a11) = self.moves.tolist()
        rows = self.emissions(blocks).tolist()
        s0, s1 = self.starts[0] + rows[0][0], self.starts[1] + rows[0][1]
        back = []
        for e0, e1 in rows[1:]:
            b0, b1 = s1 + a10 > s0 + a00, s1 + a11 >= s0 + a01
            back.append((b0, b1))
            s0, s1 = (s1 + a10 if b0 else s0 + a00) + e0, (s1 + a11 if b1 else s0 + a01) + e1
        label = int(s1 >= s0)
        out = [label]
        for pair in reversed(back):
            label = int(pair[label])
            out.append(label)
        return out[::-1]

    def extract(self, page: str) -> tuple[str, int]:
        """Main text and the number of its blocks."""
        blocks = leaf_blocks(page)
        kept = [b[0] for b, label in zip(blocks, self.labels(blocks), strict=True) if label]
        return "\n\n".join(kept), len(kept)


def fit(pages: list[list[tuple[list[str], int]]], steps: int = STEPS, decay: float = 0.005) -> Tagger:
    """Maximum likelihood with a quadratic penalty, by Adam over all pages at once.

    ``pages`` are sequences of (features, label). Forward and backward sums run over positions, with all
    pages side by side.
    """
    vocabulary: dict[str, int] = {}
    for page in pages:
        for features, _ in page:
            for f in features:
                vocabulary.setdefault(f, len(vocabulary))
    longest, n = max(map(len, pages)), len(pages)
    row, col = [], []
    label = np.zeros((n, longest), np.int64)
    real = np.zeros((n, longest), bool)
    for i, page in enumerate(pages):
        for t, (features, y) in enumerate(page):
            label[i, t], real[i, t] = y, True
            row += [i * longest + t] * len(features)
            col += [vocabulary[f] for f in features]
    row, col = np.array(row), np.array(col)
    size = len(vocabulary) * 2
    theta = np.zeros(size + 6)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    gold = np.zeros((n, longest, 2))
    gold[np.arange(n)[:, None], np.arange(longest), label] = 1
    gold *= real[..., None]
    gold_moves = np.einsum("nti,ntj->ij", gold[:, :-1], gold[:, 1:])
    blocks = real.sum()

    def logsum(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis)
        return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis))

    for step in range(1, steps + 1):
        weights, moves, starts = theta[:size].reshape(-1, 2), theta[size:size + 4].reshape(2, 2), theta[size + 4:]
        score = np.stack([np.bincount(row, weights[col, y], n * longest) for y in (0, 1)], -1).reshape(n, longest, 2)
        forward, backward = np.zeros_like(score), np.zeros_like(score)
        forward[:, 0] = starts + score[:, 0]
        for t in range(1, longest):
            new = logsum(forward[:, t - 1, :, None] + moves, 1) + score[:, t]
            forward[:, t] = np.where(real[:, t, None], new, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = logsum(moves + (score[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(real[:, t + 1, None], new, backward[:, t + 1])
        whole = logsum(forward[:, -1], 1)
        marginal = np.exp(forward + backward - whole[:, None, None]) * real[..., None]
        pair = forward[:, :-1, :, None] + moves + (score + backward)[:, 1:, None, :] - whole[:, None, None, None]
        expected = (np.exp(pair) * real[:, 1:, None, None]).sum((0, 1))
        gap = (gold - marginal).reshape(-1, 2)
        gradient = np.concatenate([
            np.stack([np.bincount(col, gap[row, y], len(vocabulary)) for y in (0, 1)], -1).ravel(),
            (gold_moves - expected).ravel(), (gold - marginal)[:, 0].sum(0)]) / blocks - decay / 100 * theta
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient ** 2
        theta = theta + 0.1 * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-8)
    return Tagger(vocabulary, theta[:size].reshape(-1, 2), theta[size:size + 4].reshape(2, 2), theta[size + 4:])


def labelled_pages(n: int, seed: int = 5) -> Iterator[str]:
    """Pages whose text runs start with MAIN or OTHER: several layouts, with and without telling tags and names."""
    rng = random.Random(seed)
    parts = "an be co de er fo ga hi in jo ka lo me na or pe qu re si ta un ve wo xi yo zu the tion ing".split()

    def word() -> str:
        return "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))

    def words(low: int, high: int) -> str:
        return " ".join(word() for _ in range(rng.randint(low, high)))

    def prose(low: int = 1, high: int = 6) -> str:
        return " ".join(words(2, 24).capitalize() + rng.choice(".....!?") for _ in range(rng.randint(low, high)))

    def name(*choices: str) -> str:
        value = rng.choice(choices) + rng.choice(["", "", "-" + word(), " " + word(), "-1"])
        return f' {rng.choice(["class", "class", "id"])}="{value}"'

    def other(text: str) -> str:
        return OTHER + text

    def link(text: str) -> str:
        return f'<a href="/{word()}">{other(text)}</a>'

    def menu() -> str:
        items = "".join(f"<li>{link(words(1, 3))}</li>" for _ in range(rng.randint(2, 9)))
        return rng.choice([f"<nav><ul>{items}</ul></nav>", f"<div{name('menu', 'nav', 'navbar', 'navigation', 'breadcrumb')}><ul>{items}</ul></div>",
                           f'<ul role="navigation"{name("menu", "nav", "links")}>{items}</ul>',
                           "<nav>" + " ".join(link(words(1, 2)) for _ in range(5)) + "</nav>"])

    def header() -> str:
        body = rng.choice([f"<p>{other(words(1, 5))}</p>", f"<div>{link(words(1, 3))}</div>", f"<h1>{other(words(1, 4))}</h1>"])
        return rng.choice([f"<header>{body}</header>", f"<div{name('header', 'masthead', 'banner', 'topbar')}>{body}</div>",
                           f"<header{name('site', 'header')}>{body}{menu()}</header>"])

    def footer() -> str:
        text = rng.choice([f"&copy; {word()} &middot; {prose(1, 1)}", f"Copyright 2020 {word()}. All rights reserved.", prose(1, 2), words(2, 8)])
        return rng.choice([f"<footer>{other(text)}</footer>", f"<footer><p>{other(text)}</p><p>{link(words(1, 3))}</p></footer>",
                           f"<div{name('footer', 'copyright', 'colophon', 'legal')}><p>{other(text)}</p></div>"])

    def advert() -> str:
        text = other(rng.choice([prose(1, 3), words(2, 12), "Advertisement", "Sponsored: " + words(2, 6)]))
        body = rng.choice([text, f"<p>{text}</p>"])
        tag = rng.choice(["div", "div", "aside", "section"])
        return f"<{tag}{name('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'banner', 'sponsor')}>{body}</{tag}>"

    def notice() -> str:
        text = other(rng.choice(["We use cookies. " + prose(1, 2), prose(1, 3), "Please subscribe to read on. " + prose(1, 1)]))
        return f"<div{name('cookie', 'notice', 'alert', 'consent', 'popup', 'modal', 'message', 'gdpr', 'disclaimer', 'warning', 'newsletter')}>{rng.choice([text, f'<p>{text}</p>'])}</div>"

    def form() -> str:
        return (f"<form{rng.choice(['', name('search', 'login', 'subscribe', 'newsletter', 'signup')])}>"
                f"{rng.choice(['<label>', '<p>', '<div>', ''])}{other(rng.choice([words(1, 5), prose(1, 2)]))}"
                f"<input name=q><button>{other(words(1, 2))}</button></form>")

    def side() -> str:
        body = "".join(rng.choice([f"<h3>{other(words(1, 4))}</h3>", f"<p>{other(prose(1, 4))}</p>", f"<li>{link(words(2, 8))}</li>"])
                       for _ in range(rng.randint(1, 5)))
        return rng.choice([f"<aside>{body}</aside>", f"<div{name('sidebar', 'side', 'widget', 'related', 'trending', 'recommended', 'popular')}>{body}</div>",
                           f"<aside{name('sidebar', 'related', 'widget')}>{body}</aside>"])

    def share() -> str:
        return f"<div{name('share', 'social', 'sharing', 'tags', 'meta', 'byline', 'author')}>{''.join(rng.choice([link(word()), other(words(1, 4))]) for _ in range(3))}</div>"

    def comments() -> str:
        one = rng.choice(["div", "li", "article", "p"])
        each = "".join(f"<{one}{name('comment', 'reply', 'response', 'user')}>{rng.choice(['', '<p>'])}{other(prose(1, 4))}</{one}>"
                       if rng.random() < 0.7 else f"<{one}><p>{other(prose(1, 3))}</p></{one}>" for _ in range(rng.randint(1, 6)))
        tag = rng.choice(["div", "section", "ol", "ul"])
        head = rng.choice(["", f"<h2>{other('Comments')}</h2>", f"<h3>{other(words(1, 3))}</h3>"])
        return f"<{tag}{name('comments', 'comment', 'discussion', 'responses', 'replies', 'disqus')}>{head}{each}</{tag}>"

    def paragraph() -> str:
        text = prose()
        if rng.random() < 0.15:
            text = f"<b>{MAIN}{words(1, 8)}. {text}<br>"
            return f"<p>{text}"
        if rng.random() < 0.15:
            text += f' <a href="/{word()}">{words(1, 3)}</a> {words(1, 6)}.'
        if rng.random() < 0.1:
            return f"<p>{MAIN}{words(1, 4)}</p>"
        return f"<p>{MAIN}{text}{rng.choice(['</p>', '</p>', ''])}"

    def body() -> str:
        title = f"<h1>{MAIN}{words(1, 9)}{rng.choice(['', '.'])}</h1>"
        if rng.random() < 0.15:
            title = f"<header>{title}</header>"
        out = [title] if rng.random() < 0.9 else []
        for _ in range(rng.randint(1, 12)):
            kind = rng.random()
            if kind < 0.78:
                out.append(paragraph())
            elif kind < 0.84:
                out.append(f"<h2>{MAIN}{words(1, 6)}</h2>")
            elif kind < 0.89:
                out.append("<ul>" + "".join(f"<li>{MAIN}{words(2, 14)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.92:
                out.append(f"<blockquote><p>{MAIN}{prose(1, 3)}</p></blockquote>")
            elif kind < 0.94:
                out.append("<table><tr>" + "".join(f"<td>{MAIN}{words(1, 3)}</td>" for _ in range(4)) + "</tr></table>")
            elif kind < 0.96:
                out.append(f"<figure><img src=x><figcaption>{MAIN}{prose(1, 1)}</figcaption></figure>")
            else:
                out.append(rng.choice([advert, share, side, form, notice])())
        if rng.random() < 0.2:
            out.append(rng.choice([comments, share])())
        return "".join(out)

    def frame(inner: str) -> str:
        if rng.random() < 0.2:
            inner = f"<div{name('content', 'body', 'text')}>{inner}</div>"
        kind = rng.random()
        if kind < 0.5:
            return f"<article>{inner}</article>"
        if kind < 0.62:
            return f"<main><article{name('post', 'article', 'entry')}>{inner}</article></main>"
        if kind < 0.75:
            return f"<main>{inner}</main>"
        return f"<div{name('content', 'post', 'entry', 'article', 'story', 'main', 'text', 'body')}>{inner}</div>"

    for _ in range(n):
        above = [make() for make in (header, menu, advert, notice, form, side) if rng.random() < 0.4]
        below = [make() for make in (comments, side, advert, share, form, footer) if rng.random() < 0.35]
        rng.shuffle(above)
        yield f"<html><head><title>x</title></head><body>{''.join(above)}{frame(body())}{''.join(below)}{footer() if rng.random() < 0.8 else ''}</body></html>"


def training_pages(n: int = PAGES, seed: int = 5) -> list[list[tuple[list[str], int]]]:
    out = []
    for page in labelled_pages(n, seed):
        rows = []
        for text, stack, linked in leaf_blocks(page):
            label = int(text.count(MAIN) > text.count(OTHER))
            clean = text.replace(MAIN, "").replace(OTHER, "").strip()
            if clean:
                rows.append((_ancestor_features(stack) + _text_features(clean, min(linked, len(clean))), label))
        if rows:
            out.append(rows)
    return out


def main_text(pages: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """One row per page: page_id, url, text (main blocks joined by two \\n, empty if none), n_chars, n_blocks.

    ``pages`` has page_id, url and html (null: empty; others are left out). Character references are decoded
    and white space inside a block is one space. No shuffle; repeated rows give equal texts; no rows, no result.
    Without a ``tagger``, one is trained on PAGES labelled pages.
    """
    tagger = tagger or fit(training_pages())
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [tagger.extract(page.as_py() or "") for page in batch.column(2)]
            texts = [t for t, _ in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()),
                 pa.array([n for _, n in found], pa.int64())], ["page_id", "url", "text", "n_chars", "n_blocks"])

    return pages.select("page_id", "url", "html").mapInArrow(
        work, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long, n_blocks long")
