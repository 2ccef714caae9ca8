"""Pairing of opening and closing marks: the one stack the engine needs, run per page in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

PAIR_FIELDS = ["pre", "post", "parent", "depth", "sib", "tail", "own", "closers"]
PAIRS_TYPE = (
    "pre array<int>, post array<int>, parent array<int>, depth array<int>, sib array<int>, "
    "tail array<int>, own array<array<int>>, closers array<string>"
)
#: Tokens turned into Python objects at once, one page at least.
SLICE_TOKENS = 20_000


def pair_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Pair opening and closing marks of each page, see :func:`pair_marks`; every slice is handed on before the next is paired.

    Spark bounds the bytes of a batch that comes in; what goes out is several times larger and never whole in memory.
    """
    for codes in batches:
        yield from _paired(codes)


def pair_marks(codes: pa.Array) -> pa.Array:
    """Pair opening and closing marks of each page.

    Codes: ``<tag`` opens, ``/tag`` closes, ``.tag`` is a leaf, ``!tag`` a leaf with raw text, ``t`` is
    text, an empty code is skipped. A closing mark pops to the nearest open node of its name or is ignored.

    However many pages Spark puts into a batch, only a few are Python objects at a time: the rest is packed Arrow data.
    """
    made = list(_paired(codes))
    return pa.concat_arrays(made) if made else pa.array([], pa.struct(list(_kinds().items())))


def _kinds() -> dict[str, pa.DataType]:
    numbers = pa.list_(pa.int32())
    return dict.fromkeys(PAIR_FIELDS, numbers) | {"own": pa.list_(numbers), "closers": pa.list_(pa.string())}


def _paired(codes: pa.Array) -> Iterator[pa.Array]:
    kinds = _kinds()
    sizes = codes.value_lengths().to_pylist()  # null: no page
    for start, stop in _slices(sizes):
        tokens = codes.slice(start, stop - start).flatten().to_numpy(zero_copy_only=False).tolist()
        pages, at = [], 0
        for size in sizes[start:stop]:
            pages.append(pair_page(None if size is None else tokens[at:at + size]))
            at += size or 0
        columns = [pa.array(values, kinds[field]) for field, values in zip(PAIR_FIELDS, zip(*pages, strict=True), strict=True)]
        yield pa.StructArray.from_arrays(columns, fields=[pa.field(f, kinds[f]) for f in PAIR_FIELDS])


def _slices(sizes: list[int | None]) -> Iterator[tuple[int, int]]:
    """First page and end of each slice of at most :data:`SLICE_TOKENS` tokens, or of one page."""
    start = tokens = 0
    for at, size in enumerate(sizes):
        if at > start and tokens + (size or 0) > SLICE_TOKENS:
            yield start, at
            start, tokens = at, 0
        tokens += size or 0
    if start < len(sizes):
        yield start, len(sizes)


def pair_page(codes) -> tuple | list:
    if codes is None:
        return [None] * len(PAIR_FIELDS)
    size = len(codes)
    pre, post, parent, depth, tail, own, kids, sib = [], [], [], [], [], [], [], []
    closers = [""] * size
    stack: list[tuple[int, str]] = []  # (node number, tag)
    open_count: dict[str, int] = {}

    def close(node: int, tag: str, at: int) -> None:
        post[node] = at
        closers[at - 1] += f"</{tag}>"

    for at, code in enumerate(codes, 1):
        kind = code[:1]
        if kind == "" or (kind == "t" and not stack):
            continue
        if kind == "t":
            own[stack[-1][0]].append(at)
        elif kind == "/":
            tag = code[1:]
            if open_count.get(tag):
                while True:
                    node, name = stack.pop()
                    open_count[name] -= 1
                    close(node, name, at)
                    if name == tag:
                        break
        else:
            node, above = len(pre), stack[-1][0] if stack else -1
            pre.append(at)
            post.append(at)
            parent.append(pre[above] if above >= 0 else 0)
            depth.append(len(stack) + 1)
            sib.append(kids[above] if above >= 0 else open_count.get("", 0))
            own.append([at] if kind == "!" else [])
            kids.append(0)
            tail.append(0)
            if above >= 0:
                kids[above] += 1
            else:
                open_count[""] = open_count.get("", 0) + 1
            if kind == "<":
                stack.append((node, code[1:]))
                open_count[code[1:]] = open_count.get(code[1:], 0) + 1
            else:
                close(node, code[1:], at)
    while stack:
        node, name = stack.pop()
        close(node, name, size)
    number = {p: i for i, p in enumerate(pre)}
    for node, at in enumerate(pre):
        code = codes[at - 1]
        up = number.get(parent[node])
        shared = up is not None and post[up] == post[node]
        tail[node] = len(code) + 2 + (tail[up] if shared else 0)
    return pre, post, parent, depth, sib, tail, own, closers
