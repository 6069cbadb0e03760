"""Prompt and training-example columns.

Templates are filled with ``replace`` for the class slots and by splitting
the template once at ``{sentence}`` (the sentence is inserted verbatim, so
braces in it stay literal). With literal classes Catalyst folds the system
text to a constant.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.constants import (
    ASSISTANT_PROMPT, CLASS_0, CLASS_1, REASONING_MODELS, SYSTEM_PROMPT_CHAT,
    SYSTEM_PROMPT_SIMPLE, USER_PROMPT_CHAT, USER_PROMPT_COMPLETION,
)

MESSAGES_TYPE = "array<struct<role:string,content:string>>"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _lit(x: Column | str) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _fill(template: str, slot: str, value: Column) -> Column:
    """Insert ``value`` at every ``{slot}`` of a literal template, verbatim."""
    parts = template.split("{" + slot + "}")
    out: list[Column] = [F.lit(parts[0])]
    for p in parts[1:]:
        out += [value, F.lit(p)]
    return F.concat(*out)


def render_system_prompt(template: str = SYSTEM_PROMPT_CHAT, class0: Column | str = CLASS_0, class1: Column | str = CLASS_1) -> Column:
    """B1: fill {class0} and {class1}."""
    if not isinstance(class0, Column) and not isinstance(class1, Column):
        return F.lit(template.format(class0=class0, class1=class1))
    c0, c1 = _lit(class0), _lit(class1)
    pieces: list[Column] = []
    for i, part in enumerate(template.split("{class0}")):
        if i:
            pieces.append(c0)
        sub = part.split("{class1}")
        for j, q in enumerate(sub):
            if j:
                pieces.append(c1)
            pieces.append(F.lit(q))
    return F.concat(*pieces)


def render_user_prompt(sentence: Column | str, template: str = USER_PROMPT_CHAT) -> Column:
    """B2: fill {sentence}; the sentence is literal text."""
    return _fill(template, "sentence", _c(sentence))


def prompt_completion(system: Column, user: Column) -> Column:
    """``system + "\\n"`` when system is non-empty, then ``user + "\\n"``."""
    return F.concat(F.when(system != "", F.concat(system, F.lit("\n"))).otherwise(F.lit("")), user, F.lit("\n"))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def prompt_chat(system: Column, user: Column) -> Column:
    """[system, user] messages."""
    return F.array(message("system", system), message("user", user))


def prompt_merged(system: Column, user: Column) -> Column:
    """One user message ``system + "\\n" + user``."""
    return F.array(message("user", F.concat(system, F.lit("\n"), user)))


def prompt_reasoning(user: Column) -> Column:
    """The input message of the reasoning path: merged with an empty system,
    so the content starts with a newline. Instructions travel separately."""
    return prompt_merged(F.lit(""), user)


def is_reasoning_model(model: Column | str) -> Column:
    """Lower-cased model name contains any reasoning-model id."""
    m = F.lower(_c(model))
    out = F.lit(False)
    for rid in REASONING_MODELS:
        out = out | F.contains(m, F.lit(rid))
    return out


def class_order_swapped(seed: Column | str | int, idx: Column | str) -> Column:
    """Per-row class order, reproducible and partition-independent.

    True when md5('order:{seed}:{idx}') starts with a hex digit >= 8.
    """
    s = F.lit(str(seed)) if isinstance(seed, int) else _c(seed).cast("string")
    return F.substring(F.md5(F.concat_ws(":", F.lit("order"), s, _c(idx).cast("string"))), 1, 1) >= "8"


def shuffled_classes(seed: Column | str | int, idx: Column | str, class0: str = CLASS_0, class1: str = CLASS_1) -> tuple[Column, Column]:
    swapped = class_order_swapped(seed, idx)
    first = F.when(swapped, F.lit(class1)).otherwise(F.lit(class0))
    second = F.when(swapped, F.lit(class0)).otherwise(F.lit(class1))
    return first, second


def answer_text(label_text: Column) -> Column:
    """Assistant answer ``RĂSPUNS: {label}``."""
    return _fill(ASSISTANT_PROMPT, "answer", label_text)


def training_example_chat(sentence: Column | str, label_text: Column | str, merge_system_into_user: bool = False,
                          system_template: str = SYSTEM_PROMPT_SIMPLE) -> Column:
    """Chat messages plus the assistant answer."""
    system = render_system_prompt(system_template)
    user = render_user_prompt(sentence, USER_PROMPT_CHAT)
    msgs = prompt_merged(system, user) if merge_system_into_user else prompt_chat(system, user)
    return F.concat(msgs, F.array(message("assistant", answer_text(_c(label_text)))))


def training_example_completion(sentence: Column | str, label_text: Column | str,
                                system_template: str = SYSTEM_PROMPT_SIMPLE,
                                user_template: str = USER_PROMPT_CHAT) -> tuple[Column, Column]:
    """(prompt, completion)."""
    prompt = prompt_completion(render_system_prompt(system_template), render_user_prompt(sentence, user_template))
    return prompt, answer_text(_c(label_text))


def prompt_to_json(prompt: Column) -> Column:
    """JSON text of a messages array, non-ASCII kept."""
    return F.to_json(prompt)


def json_string(text: Column) -> Column:
    """B12 for a plain-text prompt: the JSON string literal (quoted, escaped).

    ``to_json`` takes only nested types, so the text is encoded as a
    one-element array and the brackets are cut off.
    """
    js = F.to_json(F.array(text))
    return F.when(text.isNotNull(), F.substring(js, F.lit(2), F.length(js) - 2))


def prompt_for_run(sentence: Column | str, class0: Column, class1: Column, *, use_completion: bool = False,
                   from_ft_model: bool = False, merge_system_into_user: bool = False, model: str = "") -> dict[str, Column]:
    """The prompt of one run configuration.

    Returns ``{"kind", "prompt_text", "messages", "instructions"}``; unused
    entries are null. Completion mode passes the prompt text (the original
    asserts a string but builds a dict; the evident intent is the text).
    """
    null_msgs = F.lit(None).cast(MESSAGES_TYPE)
    null_str = F.lit(None).cast("string")
    simple = render_system_prompt(SYSTEM_PROMPT_SIMPLE, class0, class1)
    chat = render_system_prompt(SYSTEM_PROMPT_CHAT, class0, class1)
    system = simple if from_ft_model else chat
    if use_completion:
        text = prompt_completion(simple, render_user_prompt(sentence, USER_PROMPT_COMPLETION))
        return {"kind": F.lit("completion"), "prompt_text": text, "messages": null_msgs, "instructions": null_str}
    user = render_user_prompt(sentence, USER_PROMPT_CHAT)
    if any(r in model.lower() for r in REASONING_MODELS):
        return {"kind": F.lit("reasoning"), "prompt_text": null_str, "messages": prompt_reasoning(user), "instructions": system}
    msgs = prompt_merged(system, user) if merge_system_into_user else prompt_chat(system, user)
    return {"kind": F.lit("chat"), "prompt_text": null_str, "messages": msgs, "instructions": null_str}
