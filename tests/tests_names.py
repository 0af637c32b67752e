"""Identifier parts as the library defines them, in plain Python."""

import re


def parts(name):
    return [p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", name)]
