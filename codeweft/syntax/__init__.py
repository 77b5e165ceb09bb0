"""Tolerant parsers of Python, JavaScript, Java and Go into typed nodes."""

from __future__ import annotations

from .golang import GoParser
from .java import JavaParser
from .javascript import JavaScriptParser
from .node import Node
from .python import PythonParser

PARSERS = {"python": PythonParser, "javascript": JavaScriptParser, "java": JavaParser, "go": GoParser}


def parse(text: str, language: str) -> Node:
    """The root node of a source text. Never fails on malformed text."""
    return PARSERS[language](text).parse()
