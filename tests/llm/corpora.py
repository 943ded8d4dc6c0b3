"""A small corpus with every awkward case."""

import random

WORDS = ("the of and to in that it was for on are with as his they be at one have this from or had "
         "by hot but some what there we can out other were all your when up use word how said").split()


def prose(seed, count, line=9):
    draw = random.Random(seed)
    out = [draw.choice(WORDS) + draw.choice(["", "", str(draw.randrange(50))]) for _ in range(count)]
    out = [w + ("." if n % 7 == 6 else "") for n, w in enumerate(out)]
    return "\n".join(" ".join(out[n:n + line]) for n in range(0, count, line))


def corpus():
    """(doc_id, text): copies, near copies, shared passages, NULLs, blanks, a long text."""
    base, passage = prose(1, 120), prose(2, 60)
    near = base.split(" ")
    near[40] = "changed"
    rows = [(n, prose(100 + n, 40 + 7 * n)) for n in range(10, 30)]
    rows += [(1, base), (2, base), (40, " ".join(near)), (41, base.upper()), (42, base + " \n more words"),
             (50, prose(5, 50) + "\n" + passage + "\n" + prose(6, 33)), (51, passage),
             (52, prose(7, 20) + "\n" + passage), (60, None), (61, ""), (62, " \n\t "), (63, "two words"),
             (64, "two words"), (65, "one"), (66, "a\n\n\nb\n\n\nc"), (67, prose(9, 6000)),
             (None, base), (None, "no id but text here " * 5), (70, prose(11, 30)), (70, prose(11, 30)),
             (71, "é ü ß " * 12 + "日本 語 \u00a0x"), (-5, passage + "\nzero")]
    return rows
