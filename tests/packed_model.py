"""A sequential, character-wise model of packed fields, against which the expressions are tested."""

import re


class Value:
    """A value under way: the quoted part, if it began with one, and the text after it."""

    def __init__(self):
        self.quoted, self.text = None, ""

    def fresh(self):
        return self.quoted is None and not self.text.strip(" ")

    def done(self):
        return self.text.strip(" ") if self.quoted is None else self.quoted + self.text.rstrip(" ")


def quoted_at(text, i):
    """The content of the quoted span at i and the place after it, or None."""
    mark, out, j = text[i], "", i + 1
    while j < len(text):
        if text[j] != mark:
            out += text[j]
            j += 1
        elif text[j + 1 : j + 2] == mark:
            out += mark
            j += 2
        else:
            return out, j + 1
    return None


def parse_list(text, separator, commas, brackets):
    """The values of every item of a format or sample."""
    items, values, value, i = [], [], Value(), 0
    while i < len(text):
        c = text[i]
        if c in "\"'" and value.fresh() and (span := quoted_at(text, i)):
            value.quoted, value.text = span[0], ""
            i = span[1]
            continue
        if brackets and c in "[]" and (j := text.find(c, i + 1)) >= 0:
            value.text += text[i : j + 1]
            i = j + 1
            continue
        if separator and c == separator or commas and c == ",":
            values.append(value.done())
            value = Value()
            if c == separator:
                items.append(values)
                values = []
        else:
            value.text += c
        i += 1
    return [*items, [*values, value.done()]]


def parse_info(text):
    """(key, whether it holds '=', values) of every item of an info field."""
    items, key, values, value, i = [], "", [], None, 0

    def end_value():
        if value.quoted is not None or value.done():
            values.append(value.done())

    def end_item():
        if value is not None:
            end_value()
            items.append((key.strip(" "), True, values or [""]))
        elif key.strip(" "):
            items.append((key.strip(" "), False, [""]))

    while i < len(text):
        c = text[i]
        if value is not None and c in "\"'" and value.fresh() and (span := quoted_at(text, i)):
            value.quoted, value.text = span[0], ""
            i = span[1]
            continue
        if c in ";|\t":
            end_item()
            key, values, value = "", [], None
        elif value is None and c == "=":
            value = Value()
        elif value is None:
            key += c
        elif c == ",":
            end_value()
            value = Value()
        else:
            value.text += c
        i += 1
    end_item()
    return items


def rows(caller, corrected):
    """(ord, fld, item_no, item_key, val_no, val) of (ord, info, format) and (ord, format, sample) rows."""
    out = []
    separator = lambda fmt: m[0] if (m := re.search("[:;|]", fmt or "")) else ""
    for o, info, fmt in caller:
        for n, (key, _, values) in enumerate(parse_info(info) if info is not None else [], 1):
            out += [(o, "info", n, key, m, v) for m, v in enumerate(values, 1)]
        for n, key in enumerate(parse_list(fmt, separator(fmt), False, False) if fmt is not None else [], 1):
            out.append((o, "format", n, "", 1, key[0]))
    for o, fmt, sample in corrected:
        for n, values in enumerate(parse_list(sample, separator(fmt), True, True) if sample is not None else [], 1):
            out += [(o, "sample", n, "", m, v) for m, v in enumerate(values, 1)]
    return out
