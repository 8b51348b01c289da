from __future__ import annotations

import pytest

from panelmill.llm import chat


def whole_prefixes(template, turns):
    """Added text and whether earlier output changed, from every prefix rendered in full."""
    out, before = [], template([])
    for k in range(1, len(turns) + 1):
        after = template(turns[:k])
        keeps = after.startswith(before)
        cut = (len(before) if k > 1 else 0) if keeps else chat._common(before, after)
        out.append((after[cut:], not keeps))
        before = after
    return out


def last_forty(turns):
    return "".join(f"<{role}>{text}" for role, text in turns[-40:])


def late_system(turns):
    late = any(role == "system" for role, _ in turns[50:])
    return "".join(f"<{role}>{'gone' if late and k == 1 else text}" for k, (role, text) in enumerate(turns))


def first_is_user(turns):
    said = turns[1:] if turns and turns[0][0] == "system" else turns
    if said and said[0][0] != "user":
        raise ValueError("a user speaks first")
    return "".join(f"<{role}>{text}" for role, text in turns)


@pytest.mark.parametrize("template", [last_forty, late_system, first_is_user])
def test_every_prefix_is_rendered(template):
    turns = [("system", "be brief")] + [(("user", "assistant")[k % 2], f"turn {k}") for k in range(69)]
    if template is late_system:
        turns[50] = ("system", "forget the first")
    renderer = chat.Renderer(template)
    found = [renderer.add(*turn) for turn in turns]
    assert [(span, rewrites) for span, _, _, rewrites in found] == whole_prefixes(template, turns)
    assert any(rewrites for *_, rewrites in found) == (template is not first_is_user)
