"""Facts of one file, read off its syntax nodes: imports, functions, classes,
inheritance, identifiers and comments.

Every function takes the root node and yields plain tuples in order of emission.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from ..syntax.node import Node, scan

_ASCII_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")


def _unquoted(n: Node | None) -> str | None:
    """What a string holds; nothing for an empty one or a template."""
    if n is None or n.type != "string" or len(n.text) < 3 or n.text[0] == "`":
        return None
    return n.text[1:-1]


# -- imports --------------------------------------------------------------------------
def imports(root: Node, language: str) -> list[tuple[str, str, str, bool, int]]:
    """(module, item, alias, wildcard, line from 1) of each binding."""
    return {"python": _python_imports, "javascript": _javascript_imports, "java": _java_imports, "go": _go_imports}[language](root)


def _python_imports(root: Node) -> list:
    whole, items = [], []
    for n in root.of("import_statement", "import_from_statement"):
        if n.type == "import_statement":
            for k in n.kids:
                if k.type == "aliased_import":
                    name = k.get("name")
                    whole.append((name.text, "", k.get("alias").text, False, name.row + 1))
                else:
                    whole.append((k.text, "", k.text, False, k.row + 1))
            continue
        module = n.get("module_name")
        if module is None:
            continue
        for k in n.kids[1:]:
            if k.type == "wildcard_import":
                whole.append((module.text, "", "", True, module.row + 1))
            elif k.type == "aliased_import":
                items.append((module.text, k.get("name").text, k.get("alias").text, False, module.row + 1))
            else:
                items.append((module.text, k.text, k.text, False, module.row + 1))
    return whole + items


def _javascript_imports(root: Node) -> list:
    whole, items, required = [], [], []
    for n in root.of("import_statement", "lexical_declaration"):
        if n.type == "import_statement":
            source = n.get("source")
            module = _unquoted(source)
            clause = n.get("clause")
            for k in clause.kids if module and clause else ():
                if k.type == "identifier":
                    whole.append((module, "", k.text, False, source.row + 1))
                elif k.type == "namespace_import" and k.get("name"):
                    whole.append((module, "", k.get("name").text, False, source.row + 1))
                elif k.type == "named_imports":
                    for s in k.kids:
                        if s.get("name") is not None and s.get("name").type == "identifier":
                            items.append((module, s.get("name").text, (s.get("alias") or s.get("name")).text, False, source.row + 1))
            continue
        found = []
        for d in n.kids:
            name, value = d.get("name"), d.get("value")
            if name is None or value is None:
                continue
            awaited = value.type == "await_expression" and value.kids and value.kids[0].type == "call_expression"
            call = value.kids[0] if awaited else value
            if call.type != "call_expression":
                continue
            target = call.get("function")
            source = next((a for a in call.get("arguments").kids if _unquoted(a)), None)
            module = _unquoted(source)
            if not module:
                continue
            row = source.row + 1
            if awaited and target.type == "import" and name.type == "identifier":
                whole.append((module, "", name.text, False, row))
            if awaited or target.type != "identifier" or target.text != "require":
                continue
            if name.type == "identifier":
                found.append((0, name.start, (module, "", name.text, False, row)))
            elif name.type == "object_pattern":
                for k in name.kids:
                    if k.type == "pair_pattern" and k.get("key").type == "property_identifier" and k.get("value") is not None and k.get("value").type == "identifier":
                        # The alias is the name bound; it is what the pattern's key is called by.
                        found.append((1, k.start, (module, k.get("key").text, k.get("value").text, False, row)))
                    elif k.type == "shorthand_property_identifier_pattern":
                        found.append((2, k.start, (module, k.text, k.text, False, row)))
        required += [x for _, _, x in sorted(found, key=lambda f: f[:2])]
    return whole + items + required


def _java_imports(root: Node) -> list:
    out = []
    for n in root.of("import_declaration"):
        name = n.get("name")
        if name is None or name.type != "scoped_identifier":
            continue
        star = n.get("asterisk") is not None
        module = re.sub(r"\s+", "", name.text)
        out.append((module, "", "" if star else name.get("name").text, star, name.row + 1))
    return out


def _go_imports(root: Node) -> list:
    out = []
    for n in root.of("import_spec"):
        path, name = n.get("path"), n.get("name")
        if path is None or path.type != "interpreted_string_literal":
            continue
        star = name is not None and name.type in ("dot", "blank_identifier")
        alias = "" if star else name.text if name is not None else path.text
        out.append((path.text, "", alias, star, path.row + 1))
    return out


# -- functions --------------------------------------------------------------------------
class _Function:
    """One row of the functions table, before it is made a tuple."""

    def __init__(self, name: Node, kind: str, parent: str = "", access: str = "public"):
        self.name, self.kind, self.parent, self.access = name, kind, parent, access
        self.parameters: list[str] = []
        self.returns, self.body = "", None
        self.decorators: list[str] = []
        self.abstract = self.static = self.is_async = False

    def row(self) -> tuple:
        return (self.name.text, self.parameters, self.returns, self.kind, self.access, self.parent, self.decorators, self.abstract, self.static, self.is_async, self.body.text if self.body else "", len(self.name.source.text[: self.name.start].encode("utf-8", "surrogatepass")), self.name.row + 1)


def _enclosing(n: Node, *types: str) -> str:
    """The name of the nearest class around a node."""
    return next((a.get("name").text for a in n.ancestors() if a.type in types and a.get("name") is not None), "")


def _key(f: _Function) -> tuple:
    return (f.parent, f.name.text) if f.parent else ("", f.name.text, f.name.row)


def functions(root: Node, language: str) -> list[tuple]:
    """(name, parameters, return type, type, access, parent class, decorators, abstract, static, async, body, start byte, line), one for each key; order of first appearance."""
    found: dict[tuple, _Function] = {}
    {"python": _python_functions, "javascript": _javascript_functions, "java": _java_functions, "go": _go_functions}[language](root, found)
    return [f.row() for f in found.values()]


def _python_functions(root: Node, found: dict) -> None:
    for n in root.of("function_definition"):
        name, body = n.get("name"), n.get("body")
        if name is None or n.get("parameters") is None or body is None:
            continue
        parent = _enclosing(name, "class_definition")
        plain = not parent
        is_async = plain and any(k.type == "async" for k in n.kids)
        kind = ("async" if is_async else "function") if plain else "constructor" if name.text == "__init__" else "method"
        new = _Function(name, kind, parent)
        f = found.setdefault(_key(new), new)
        f.kind, f.body = kind, body
        f.parameters = [p.text for p in n.get("parameters").kids if p.type in ("identifier", "typed_parameter", "default_parameter")]
        f.is_async = f.is_async or is_async
    for n in root.of("decorated_definition"):
        d = n.get("definition")
        if d.type != "function_definition" or d.get("name") is None:
            continue
        f = found.get(_key(_Function(d.get("name"), "", _enclosing(d.get("name"), "class_definition"))))
        for mark in n.kids:
            value = mark.get("value")
            if f is None or mark.type != "decorator" or value is None or value.type != "identifier":
                continue
            f.decorators.append(mark.text)
            if value.text == "staticmethod":
                f.static, f.kind = True, "static_method"
            elif value.text == "abstractmethod":
                f.abstract = True


_JS_PARAMETERS = ("identifier", "assignment_pattern", "rest_pattern", "array_pattern", "object_pattern")


def _javascript_functions(root: Node, found: dict) -> None:
    def add(name: Node, kind: str, params: Node | None, body: Node | None, parent: str = "", is_async: bool = False, decorators: tuple = ()) -> None:
        f = _Function(name, kind, parent)
        f.body, f.is_async, f.decorators = body, is_async, list(decorators)
        if params is not None:
            f.parameters = [params.text] if params.type == "identifier" else [p.text for p in params.kids if p.type in _JS_PARAMETERS]
        found[_key(f)] = f

    for n in root.of("function_declaration"):
        if n.get("name") is not None and n.get("parameters") is not None:
            is_async = any(k.type == "async" for k in n.kids)
            add(n.get("name"), "async" if is_async else "function", n.get("parameters"), n.get("body"), is_async=is_async)
    for n in root.of("variable_declarator", "assignment_expression"):
        name, value = (n.get("name"), n.get("value")) if n.type == "variable_declarator" else (n.get("left"), n.get("right"))
        if name is not None and value is not None and name.type == "identifier" and value.type == "arrow_function":
            # Async shows only where the binding itself stands within an async arrow function.
            outer = next((a for a in name.ancestors() if a.type == "arrow_function"), None)
            is_async = outer is not None and outer.parent is not None and any(k.type == "async" for k in outer.parent.kids)
            add(name, "async" if is_async else "arrow", value.get("parameters"), value.get("body"), is_async=is_async)
    for n in root.of("method_definition"):
        name = n.get("name")
        if name is None or name.type != "property_identifier" or n.get("parameters") is None:
            continue
        is_async = any(k.type == "async" for k in n.kids)
        kind = "constructor" if name.text == "constructor" else "async" if is_async else "method"
        add(name, kind, n.get("parameters"), n.get("body"), _enclosing(name, "class_declaration"), kind == "async", tuple(k.text for k in n.kids if k.type == "decorator"))
    for n in root.of("function_expression"):
        if n.get("name") is not None and n.get("parameters") is not None:
            is_async = n.parent is not None and any(k.type == "async" for k in n.parent.kids)
            add(n.get("name"), "async" if is_async else "function", n.get("parameters"), n.get("body"), is_async=is_async)


def _java_functions(root: Node, found: dict) -> None:
    for kind in ("method_declaration", "constructor_declaration"):
        for n in root.of(kind):
            name, body = n.get("name"), n.get("body")
            if name is None or body is None or n.get("parameters") is None:
                continue
            parent = _enclosing(name, "class_declaration")
            made = kind == "constructor_declaration"
            f = _Function(name, "constructor" if made else "method" if parent else "function", parent, "package")
            f.body = body
            f.parameters = [p.text for p in n.get("parameters").kids if p.type == "formal_parameter"]
            f.returns = "" if made or n.get("type") is None else n.get("type").text
            for m in n.get("modifiers").kids if n.get("modifiers") is not None else ():
                if m.type in ("public", "private", "protected"):
                    f.access = m.type
                elif m.type == "static":
                    f.static = True
                    f.kind = "static_method" if f.kind == "method" else f.kind
                elif m.type == "abstract":
                    f.abstract = True
                elif m.type == "annotation":
                    f.decorators.append(m.text)
            found[_key(f)] = f
    # Annotations with arguments are seen a second time.
    for n in root.of("method_declaration"):
        name = n.get("name")
        f = found.get(_key(_Function(name, "", _enclosing(name, "class_declaration")))) if name is not None else None
        if f is not None and n.get("modifiers") is not None:
            f.decorators += [m.text for m in n.get("modifiers").kids if m.type == "annotation"]


def _go_functions(root: Node, found: dict) -> None:
    for kind in ("function_declaration", "method_declaration"):
        for n in root.of(kind):
            name, body = n.get("name"), n.get("body")
            if name is None or body is None or not _ASCII_NAME.match(name.text):
                continue
            parent = receiver_type(n.get("receiver")) if kind == "method_declaration" else ""
            if kind == "method_declaration" and not parent:
                continue
            f = _Function(name, "method" if parent else "function", parent, "public" if "A" <= name.text[0] <= "Z" else "package")
            f.body = body
            f.parameters = [p.text for p in n.get("parameters").kids if p.type in ("parameter_declaration", "variadic_parameter_declaration")] if n.get("parameters") else []
            found[_key(f)] = f


def receiver_type(receiver: Node | None) -> str:
    """The type of a Go method's receiver: T or *T."""
    for p in receiver.kids if receiver is not None else ():
        for t in p.kids:
            if t.type == "type_identifier":
                return t.text
            if t.type == "pointer_type" and t.kids and t.kids[0].type == "type_identifier":
                return t.kids[0].text
    return ""


# -- classes ------------------------------------------------------------------------------
class _Class:
    def __init__(self, name: str, access: str = "public"):
        self.name, self.access = name, access
        self.bases: list[str] = []
        self.methods: list[str] = []
        self.fields: list[str] = []
        self.decorators: list[str] = []
        self.constructor, self.abstract = "", False

    def row(self) -> tuple:
        return self.name, self.bases, self.methods, self.fields, self.constructor, self.decorators, self.abstract, self.access


def classes(root: Node, language: str) -> list[tuple]:
    """(name, bases, methods, fields, constructor, decorators, abstract, access); order of first appearance."""
    if language == "python":
        return [c.row() for c in _python_classes(root)]
    if language == "java":
        return [c.row() for c in _java_classes(root)]
    raise NotImplementedError(f"classes of {language}")


def _python_classes(root: Node) -> list[_Class]:
    found: dict[str, _Class] = {}
    nodes = [n for n in root.of("class_definition") if n.get("name") is not None]
    for n in nodes:
        c = found.setdefault(n.get("name").text, _Class(n.get("name").text))
        if n.get("superclasses") is not None:
            c.bases = [b.text for b in n.get("superclasses").kids if b.type in ("identifier", "attribute")]
    for n in nodes:
        c = found[n.get("name").text]
        for k in n.get("body").kids:
            if k.type == "function_definition" and k.get("name") is not None:
                c.methods.append(k.get("name").text)
                if k.get("name").text == "__init__":
                    c.constructor = "__init__"
            a = k.kids[0] if k.type == "expression_statement" and k.kids else None
            left = a.get("left") if a is not None and a.type == "assignment" else None
            if left is not None and left.type == "attribute" and left.get("object").type == "identifier" and left.get("object").text == "self":
                c.fields.append(a.text)
    for n in root.of("decorated_definition"):
        d = n.get("definition")
        if d.type != "class_definition" or d.get("name") is None:
            continue
        for mark in n.kids:
            value = mark.get("value")
            if mark.type == "decorator" and value is not None and value.type == "identifier":
                c = found[d.get("name").text]
                c.decorators.append(mark.text)
                c.abstract = c.abstract or value.text in ("abstractmethod", "ABC")
    return list(found.values())


def _java_classes(root: Node) -> list[_Class]:
    rows: list[_Class] = []
    latest: dict[str, _Class] = {}
    for kind in ("class_declaration", "interface_declaration"):
        for n in root.of(kind):
            if n.get("name") is None:
                continue
            c = _Class(n.get("name").text)
            c.abstract = kind == "interface_declaration"
            mods = next((k for k in n.kids if k.type == "modifiers"), None)
            if kind == "class_declaration":
                held = n.get("superclass")
                c.bases = [t.text for t in held.kids if t.type == "type_identifier"] if held is not None else []
                for m in mods.kids if mods is not None else ():
                    c.abstract = c.abstract or m.type == "abstract"
                    if m.type == "annotation":
                        c.decorators.append(m.text)
            rows.append(c)
            latest[c.name] = c
    for n in root.of("method_declaration", "field_declaration", "constructor_declaration"):
        if n.parent is None or n.parent.type != "class_body" or n.parent.parent is None or n.parent.parent.type != "class_declaration":
            continue
        if n.type == "constructor_declaration":
            c = latest.get(n.get("name").text)
            if c is not None:
                c.constructor = n.get("name").text
            continue
        c = latest.get(_enclosing(n, "class_declaration"))
        if c is None:
            continue
        if n.type == "method_declaration":
            c.methods.append(n.get("name").text)
        else:
            c.fields.append(n.text)
    for n in root.of("class_declaration"):
        mods = next((k for k in n.kids if k.type == "modifiers"), None)
        if mods is not None and n.get("name") is not None:
            latest[n.get("name").text].decorators += [m.text for m in mods.kids if m.type in ("annotation", "marker_annotation")]
    return rows


def shown_class(row: tuple) -> str:
    """A class in one line: its marks, bases, how much it holds. The format is a fixed value."""
    name, bases, methods, fields, constructor, decorators, abstract, access = row
    marks = f"[{', '.join(decorators)}] " if decorators else ""
    before = "".join(f"{x} " for x in (access if access != "public" else "", "abstract" if abstract else "") if x)
    return f"{marks}ClassDeclarationNode{{{before}class: {name or '<unnamed>'}{'(' + ', '.join(bases) + ')' if bases else ''}, methods: {len(methods)}, fields: {len(fields)}, constructor: {'true' if constructor else 'false'}}}"


def inheritance(root: Node, language: str) -> list[tuple[str, str, str, int]]:
    """(child, parent, relationship, line) of each base."""
    out = []
    if language == "python":
        plain, qualified = [], []
        for n in root.of("class_definition"):
            name = n.get("name")
            for b in n.get("superclasses").kids if name is not None and n.get("superclasses") is not None else ():
                if b.type == "identifier":
                    plain.append((name.start, b.start, (name.text, b.text, "inherits", name.row + 1)))
                elif b.type == "attribute" and b.get("object").type == "identifier":
                    qualified.append((name.start, b.start, (name.text, f"{b.get('object').text}.{b.get('attribute').text}", "inherits", name.row + 1)))
        out = [x for _, _, x in sorted(plain + qualified)]
    elif language == "java":
        for n in root.of("class_declaration"):
            held = n.get("superclass")
            out += [(n.get("name").text, t.text, "inherits", 0) for t in (held.kids if held is not None and n.get("name") is not None else ()) if t.type == "type_identifier"]
    else:
        raise NotImplementedError(f"inheritance of {language}")
    return out


# -- identifiers --------------------------------------------------------------------------
_UNREAD = ("import_statement", "import_from_statement", "import_declaration")


def identifiers(root: Node, language: str) -> Iterator[tuple[str, int]]:
    """(text, line from 1) of the identifiers outside imports, parents before children."""
    stack = [root]
    while stack:
        n = stack.pop()
        if n.type in ("identifier", "type_identifier"):
            yield n.text, n.row + 1
        if n.type in _UNREAD or language == "javascript" and n.type == "variable_declarator" and _requires(n):
            continue
        stack.extend(reversed(n.kids))


def _requires(n: Node) -> bool:
    """Whether the declarator's own call is of require."""
    call = next((k for k in n.kids if k.type == "call_expression"), None)
    return call is not None and any(k.type == "identifier" and k.text == "require" for k in call.kids)


# -- comments -------------------------------------------------------------------------------
def stripped(text: str, language: str) -> str:
    """The text without comments and, in Python, without strings that stand alone; nothing after the last token."""
    toks = scan(text, language)
    drop = {i for i, t in enumerate(toks) if t.kind == "comment"}
    if language == "python":
        drop |= _lone_strings(toks)
    last = max((i for i, t in enumerate(toks) if t.kind not in ("ws", "nl")), default=-1)
    return "".join(t.text for i, t in enumerate(toks) if i <= last and i not in drop)


def _lone_strings(toks: list) -> set[int]:
    """Strings that are a whole statement."""
    out, depth, fresh = set(), 0, True
    real = [i for i, t in enumerate(toks) if t.kind not in ("ws", "comment")]
    for at, i in enumerate(real):
        t = toks[i]
        if t.kind == "nl":
            fresh = fresh or not depth
            continue
        if t.kind == "string" and fresh and not depth:
            after = toks[real[at + 1]] if at + 1 < len(real) else None
            if after is None or after.kind == "nl" or after.text == ";":
                out.add(i)
        if t.text in ("(", "[", "{"):
            depth += 1
        elif t.text in (")", "]", "}"):
            depth = max(0, depth - 1)
        # A statement begins after a line end, a semicolon, or the colon of a clause.
        fresh = not depth and (t.text == ";" or t.text == ":" and _clause(toks, real, at))
    return out


def _clause(toks: list, real: list[int], at: int) -> bool:
    """Whether the colon ends the head of a clause: its line begins with a word that opens one."""
    depth = 0
    j = at - 1
    while j >= 0 and not (toks[real[j]].kind == "nl" and not depth):
        depth += toks[real[j]].text in (")", "]", "}")
        depth -= toks[real[j]].text in ("(", "[", "{")
        j -= 1
    first = toks[real[j + 1]].text if j + 1 < at else ""
    return first in ("class", "def", "async", "if", "elif", "else", "for", "while", "try", "except", "finally", "with", "match", "case")
