"""Code examples in README shapes, with the expected block worked out by hand."""

import pytest

from pkgatlas.functions.readme import code_snippet

F3 = "```"
CASES = {
    "python fence": (f"Hi\n{F3}python\nimport a\na.run()\n{F3}\n", "import a\na.run()"),
    "py tag": (f"{F3}py\nx = 1\n{F3}", "x = 1"),
    "upper tag": (f"{F3}PYTHON\nx = 1\n{F3}", "x = 1"),
    "space after tag": (f"{F3}python  \nx = 1\n{F3}", "x = 1"),
    "install then code": (
        f"{F3}python\npip install a\n{F3}\n{F3}python\nimport a\n{F3}", "import a"),
    "python wins over earlier plain": (
        f"{F3}\nfirst()\n{F3}\n{F3}python\nsecond()\n{F3}", "second()"),
    "plain fence": (f"{F3}\ny = 2\n{F3}", "y = 2"),
    "other tag": (f"{F3}pycon\n>>> a()\n{F3}", ">>> a()"),
    "shell skipped": (f"{F3}bash\nmake all\n{F3}", None),
    "json skipped then toml skipped": (f"{F3}json\n{{}}\n{F3}\n{F3}TOML\na=1\n{F3}", None),
    "unclosed": (f"{F3}python\nimport a\n", None),
    "html": (f"{F3}\n<b>x</b>\n{F3}", None),
    "bullet": (f"{F3}\n* one\n* two\n{F3}", None),
    "link": (f"{F3}\n[docs](x)\n{F3}", None),
    "bold": (f"{F3}\n**note** x\n{F3}", None),
    "less-than without close is code": (f"{F3}\n<stdin\n{F3}", "<stdin"),
    "plain prose fence counts": (f"{F3}\njust words\n{F3}", "just words"),
    "dollar install": (f"{F3}\n$ pip install a\npython -m pip install b\n\n{F3}", None),
    "install with option is no trivial install": (
        f"{F3}\npip install -U a\n{F3}", "pip install -U a"),
    "prompt without a space": (f"{F3}\n$pip  install\ta\n{F3}", None),
    "two packages are no trivial install": (f"{F3}\npip install a b\n{F3}", "pip install a b"),
    "install without a package": (f"{F3}\npip install\n{F3}", "pip install"),
    "other installer": (f"{F3}\npython3 -m pip install a\n{F3}", "python3 -m pip install a"),
    "empty fence": (f"{F3}python\n\n{F3}\n{F3}\nz()\n{F3}", "z()"),
    "indented": ("Use::\n\n    import a\n    a.go()\n\nEnd", "import a\na.go()"),
    "indented prose": ("Use\n\n    some words here\n    more words here\n", None),
    "indented after prose block": (
        "a\n    some words\n    more words\n\nb\n    x = 1\n      y = 2\n", "x = 1\n  y = 2"),
    "one indented line": ("a\n    x = 1\nb\n", None),
    "one line with an inner indent": ("a\n    x = 1    # set\nb\n", "x = 1    # set"),
    "tabs": ("a\n\tx = 1\n\ty = 2\n", "x = 1\ny = 2"),
    "at the start": ("    x = 1\n    y = 2", "x = 1\ny = 2"),
    "blank line splits": ("    x = 1\n\n    y = 2\n", None),
    "fence before indented": (f"    x = 1\n    y = 2\n{F3}\nz\n{F3}", "z"),
    "crlf": (f"{F3}python\r\nimport a\r\nb\r\n{F3}", "import a\r\nb"),
    "second block of two": (
        f"{F3}\n**x**\n{F3}\ntext\n{F3}\ngood()\n{F3}", "good()"),
    "no code": ("Just a readme.", None),
    "empty": ("", None),
    "null": (None, None),
}


def test_cases(value):
    got = value(code_snippet, [c[0] for c in CASES.values()])
    wrong = {n: (g, w) for (n, (_, w)), g in zip(CASES.items(), got) if g != w}
    assert not wrong


@pytest.mark.parametrize("lines", [20_000])
def test_very_long_blocks(value, lines):
    block = "".join(f"    x{i} = {i}\n" for i in range(lines))
    fence = f"{F3}python\n" + "y = 1\n" * lines + F3
    got = value(code_snippet, [block, fence])
    assert got[0].count("\n") == lines - 1 and got[1].count("\n") == lines - 1
