"""A tolerant parser of Python."""

from __future__ import annotations

from .node import MAX_DEPTH, Node, Parser, Source, Token, scan

_COMPOUND = {"if", "elif", "else", "for", "while", "try", "except", "finally", "with", "match", "case"}
_SIMPLE = {"return": "return_statement", "raise": "raise_statement", "assert": "assert_statement", "del": "delete_statement", "global": "global_statement", "nonlocal": "nonlocal_statement", "pass": "pass_statement", "break": "break_statement", "continue": "continue_statement"}
_WORDS = {"and", "or", "not", "in", "is", "if", "else", "lambda", "for", "await", "async", "from", "import", "as", "yield", "None", "True", "False", *_SIMPLE, *(_COMPOUND - {"match", "case"}), "def", "class"}
_AUGMENTED = {"+=", "-=", "*=", "/=", "//=", "%=", "**=", ">>=", "<<=", "&=", "^=", "|=", "@="}


class PythonParser(Parser):
    language = "python"
    binary = {":=": 1, "if": 2, "or": 3, "and": 4, "in": 6, "not": 6, "is": 6, "<": 6, ">": 6, "<=": 6, ">=": 6, "==": 6, "!=": 6, "|": 7, "^": 8, "&": 9, "<<": 10, ">>": 10, "+": 11, "-": 11, "*": 12, "/": 12, "//": 12, "%": 12, "@": 12, "**": 14}

    def __init__(self, text: str):
        self.source = Source(text)
        self.toks = self._lines(text)
        self.i = self.depth = 0
        self.no_in = False

    @staticmethod
    def _lines(text: str) -> list[Token]:
        """Tokens with NEWLINE, INDENT and DEDENT between logical lines."""
        out: list[Token] = []
        indents, depth, fresh, width = [0], 0, True, 0
        for t in scan(text, "python"):
            if t.kind == "comment":
                continue
            if t.kind == "nl":
                if not depth:
                    if not fresh:
                        out.append(Token("NEWLINE", "", t.start, t.start, True))
                    fresh, width = True, 0
                continue
            if t.kind == "ws":
                if fresh and "\\" not in t.text:
                    width = 0
                    for c in t.text:
                        width = width // 8 * 8 + 8 if c == "\t" else width + 1 if c == " " else width
                continue
            if fresh:
                fresh = False
                if width > indents[-1]:
                    indents.append(width)
                    out.append(Token("INDENT", "", t.start, t.start, True))
                while width < indents[-1]:
                    indents.pop()
                    out.append(Token("DEDENT", "", t.start, t.start, True))
            if t.text in ("(", "[", "{"):
                depth += 1
            elif t.text in (")", "]", "}"):
                depth = max(0, depth - 1)
            out.append(t)
        end = len(text)
        if not fresh:
            out.append(Token("NEWLINE", "", end, end, True))
        return out + [Token("DEDENT", "", end, end, True) for _ in indents[1:]]

    # -- statements ---------------------------------------------------------------
    def parse(self) -> Node:
        kids = []
        while self.tok:
            before = self.i
            if self.kind in ("NEWLINE", "INDENT", "DEDENT"):
                self.i += 1
                continue
            kids += self.statement()
            if self.i == before:
                kids.append(self.leaf())
        return Node("module", 0, len(self.source.text), self.source, kids)

    def end_line(self) -> list[Node]:
        """What is left of a line that couldn't be parsed."""
        rest = []
        while self.tok and self.kind not in ("NEWLINE", "INDENT", "DEDENT"):
            if self.at(";"):
                self.i += 1
                return rest
            rest.append(self.leaf())
        if self.kind == "NEWLINE":
            self.i += 1
        return rest

    def statement(self) -> list[Node]:
        self.depth += 1
        try:
            t = self.text if self.kind == "name" else ""
            if self.depth > MAX_DEPTH:
                return self.end_line()
            if self.at("@"):
                return [self.decorated()]
            if t in ("def", "class") or t == "async" and self.ahead() == "def":
                return [self.definition()]
            if t in _COMPOUND and not (t in ("match", "case") and not self._soft()):
                return [self.compound()]
            if t == "async" and self.ahead() in ("for", "with"):
                start = self.begin()
                sign = self.leaf("async")
                inner = self.compound()
                return [self.make(inner.type, start, [sign, *inner.kids], **inner.fields)]
            out = [self.simple()]
            rest = self.end_line()
            if rest:
                out.append(self.make("ERROR", rest[0].start, rest))
            return out
        finally:
            self.depth -= 1

    def _soft(self) -> bool:
        """Whether match or case opens a block: a colon ends its line."""
        j, depth = self.i + 1, 0
        if j >= len(self.toks) or self.toks[j].text in ("=", ".", ",", ")", ":", "") or self.toks[j].text in _AUGMENTED:
            return False
        while j < len(self.toks) and self.toks[j].kind != "NEWLINE":
            depth += self.toks[j].text in ("(", "[", "{")
            depth -= self.toks[j].text in (")", "]", "}")
            j += 1
        return self.toks[j - 1].text == ":" and depth == 0

    def finish(self) -> int:
        """The end of the last token that is text: line ends and indents belong to no node."""
        i = self.i - 1
        while i > 0 and self.toks[i].kind in ("NEWLINE", "INDENT", "DEDENT"):
            i -= 1
        return self.toks[i].end

    def block(self) -> Node:
        """The suite after a colon."""
        start, kids = self.begin(), []
        self.skip(":")
        if self.kind != "NEWLINE":
            start = self.begin()
            while self.tok and self.kind not in ("NEWLINE", "INDENT", "DEDENT"):
                before = self.i
                kids.append(self.simple())
                if self.skip(";"):
                    continue
                if self.kind not in ("NEWLINE", "DEDENT") and self.i == before:
                    kids.append(self.leaf())
            if self.kind == "NEWLINE":
                self.i += 1
            return self.make("block", start, kids)
        self.i += 1
        if self.kind == "INDENT":
            self.i += 1
            start = self.begin()
            while self.tok and self.kind != "DEDENT":
                before = self.i
                if self.kind in ("NEWLINE", "INDENT"):
                    self.i += 1
                    continue
                kids += self.statement()
                if self.i == before:
                    kids.append(self.leaf())
            if self.tok:
                self.i += 1
        return Node("block", start, max([start, *[k.end for k in kids]]), self.source, kids)

    def decorated(self) -> Node:
        start, kids = self.begin(), []
        while self.skip("@"):
            begin = self.toks[self.i - 1].start
            value = self.expression()
            kids.append(self.make("decorator", begin, [value], value=value))
            rest = self.end_line()
            if rest:
                kids.append(self.make("ERROR", rest[0].start, rest))
        if self.kind == "name" and (self.text in ("def", "class") or self.text == "async" and self.ahead() == "def"):
            d = self.definition()
            return self.make("decorated_definition", start, [*kids, d], definition=d)
        return self.make("ERROR", start, kids)

    def definition(self) -> Node:
        start = self.begin()
        sign = [self.leaf("async")] if self.at("async") else []
        word = self.leaf().text
        name = self.leaf("identifier") if self.kind == "name" else None
        if self.at("["):
            types = self.flat("type_parameter", "]")
        else:
            types = None
        if word == "class":
            bases = None
            if self.at("("):
                bases = self.arguments()
            body = self.block()
            return self.make("class_definition", start, [name, types, bases, body], name=name, superclasses=bases, body=body)
        params = self.parameters("(", ")") if self.at("(") else None
        returns = None
        if self.skip("->"):
            inner = self.expression()
            returns = self.make("type", inner.start, [inner])
        body = self.block()
        return self.make("function_definition", start, [*sign, name, types, params, returns, body], name=name, parameters=params, return_type=returns, body=body)

    def parameters(self, opening: str, close: str, kind: str = "parameters") -> Node:
        start = self.begin()
        if opening:
            self.skip(opening)
        out = []
        while self.tok and not self.at(close) and self.kind not in ("NEWLINE", "INDENT", "DEDENT"):
            if self.skip(",", "/"):
                continue
            begin, before = self.begin(), self.i
            star = self.leaf() if self.at("*", "**") else None
            name = self.leaf("identifier") if self.kind == "name" else None
            if star is not None:
                name = self.make("list_splat_pattern" if star.text == "*" else "dictionary_splat_pattern", begin, [name])
            kids, kind_of, fields = [name], name.type if name else "ERROR", {}
            if kind == "parameters" and self.skip(":"):
                inner = self.expression()
                t = self.make("type", inner.start, [inner])
                kids.append(t)
                kind_of, fields = "typed_parameter", {"type": t}
            if self.skip("="):
                value = self.expression()
                kids.append(value)
                kind_of = "typed_default_parameter" if kind_of == "typed_parameter" else "default_parameter"
                fields |= {"value": value, "name": name}
            out.append(name if len(kids) == 1 and name is not None else self.make(kind_of, begin, kids, **fields))
            if self.i == before:
                out[-1] = self.leaf()
        if opening:
            self.skip(close)
        return self.make(kind, start, out)

    def compound(self) -> Node:
        start = self.begin()
        word = self.leaf().text
        kids: list[Node] = []
        if word == "for":
            self.no_in = True
            kids.append(self.expressions("pattern_list"))
            self.no_in = False
            if self.skip("in"):
                kids.append(self.expressions("expression_list"))
        elif word not in ("else", "try", "finally"):
            while self.tok and not self.at(":") and self.kind not in ("NEWLINE", "INDENT", "DEDENT"):
                before = self.i
                if self.skip(",", "*"):
                    continue
                item = self.expression()
                if self.skip("as"):
                    target = self.expression()
                    item = self.make("as_pattern", item.start, [item, self.make("as_pattern_target", target.start, [target])])
                kids.append(item)
                if self.i == before:
                    kids.append(self.leaf())
        kids.append(self.block())
        kind = {"elif": "elif_clause", "else": "else_clause", "except": "except_clause", "finally": "finally_clause", "case": "case_clause"}.get(word, f"{word}_statement")
        follow = {"if": ("elif", "else"), "for": ("else",), "while": ("else",), "try": ("except", "else", "finally")}.get(word, ())
        while self.kind == "name" and self.text in follow:
            kids.append(self.compound())
        return self.make(kind, start, kids, body=kids[-1])

    def simple(self) -> Node:
        start, t = self.begin(), self.text if self.kind == "name" else ""
        if t == "import":
            return self.import_()
        if t == "from" and self.ahead_kind() in ("name", "op"):
            return self.import_from()
        if t in _SIMPLE:
            self.i += 1
            kids = []
            while self.tok and self.kind not in ("NEWLINE", "INDENT", "DEDENT") and not self.at(";"):
                before = self.i
                if self.skip(",", "from"):
                    continue
                kids.append(self.expressions("expression_list"))
                if self.i == before:
                    kids.append(self.leaf())
            return self.make(_SIMPLE[t], start, kids)
        left = self.expressions("expression_list")
        inner = self._assigned(left)
        return self.make("expression_statement", start, [inner])

    def _assigned(self, left: Node) -> Node:
        if self.text in _AUGMENTED and self.kind == "op":
            self.i += 1
            right = self.expressions("expression_list")
            return self.make("augmented_assignment", left.start, [left, right], left=left, right=right)
        t = None
        if self.at(":"):
            self.i += 1
            inner = self.expression()
            t = self.make("type", inner.start, [inner])
        if self.skip("="):
            right = self._assigned(self.expressions("expression_list"))
            return self.make("assignment", left.start, [left, t, right], left=left, type=t, right=right)
        return self.make("assignment", left.start, [left, t], left=left, type=t) if t else left

    def dotted(self) -> Node:
        start, kids = self.begin(), []
        while self.kind == "name":
            kids.append(self.leaf("identifier"))
            if not self.skip("."):
                break
        return self.make("dotted_name", start, kids)

    def import_(self) -> Node:
        start = self.begin()
        self.i += 1
        names = []
        while self.kind == "name":
            names.append(self.imported())
            if not self.skip(","):
                break
        return self.make("import_statement", start, names)

    def imported(self) -> Node:
        name = self.dotted()
        if self.skip("as") and self.kind == "name":
            alias = self.leaf("identifier")
            return self.make("aliased_import", name.start, [name, alias], name=name, alias=alias)
        return name

    def import_from(self) -> Node:
        start = self.begin()
        self.i += 1
        begin, dots = self.begin(), 0
        while self.at(".", "..."):
            self.i += 1
            dots += 1
        name = self.dotted() if self.kind == "name" and self.text != "import" else None
        module = self.make("relative_import", begin, [name]) if dots else name
        future = module is not None and module.text == "__future__"
        names: list[Node] = []
        if self.skip("import"):
            bracket = self.skip("(")
            if self.at("*"):
                names.append(self.leaf("wildcard_import"))
            while self.kind == "name":
                names.append(self.imported())
                if not self.skip(","):
                    break
            if bracket:
                self.skip(")")
        return self.make("future_import_statement" if future else "import_from_statement", start, [module, *names], module_name=module)

    # -- expressions ----------------------------------------------------------------
    def expressions(self, kind: str) -> Node:
        """One expression, or several with commas between."""
        start, first = self.begin(), self.starred()
        if not self.at(","):
            return first
        items = [first]
        while self.skip(","):
            if not self.tok or self.kind in ("NEWLINE", "INDENT", "DEDENT") or self.at("=", ")", "]", "}", ":", ";", "in"):
                break
            items.append(self.starred())
        return self.make(kind, start, items)

    def starred(self) -> Node:
        if self.at("*", "**"):
            start = self.begin()
            kind = "list_splat" if self.leaf().text == "*" else "dictionary_splat"
            return self.make(kind, start, [self.expression()])
        return self.expression()

    def binary_type(self, op: str) -> str:
        return "named_expression" if op == ":=" else "boolean_operator" if op in ("and", "or") else "comparison_operator" if self.binary[op] == 6 else "binary_operator"

    def operator(self) -> str:
        op = super().operator()
        if op == "in" and self.no_in or op == "not" and self.ahead() != "in":
            return ""
        return op

    def take_operator(self, op: str) -> list[Node]:
        if op == "if":
            self.i += 1
            middle = self.expression(2)
            self.skip("else")
            return [middle]
        out = [self.leaf(op)]
        if op == "not" and self.at("in") or op == "is" and self.at("not"):
            out.append(self.leaf(self.text))
        return out

    def make(self, kind: str, start: int, kids: list, **fields) -> Node:
        if kind == "binary_operator" and len(kids) == 3 and kids[1].type not in self.binary:
            kind, fields = "conditional_expression", {}
        return super().make(kind, start, kids, **fields)

    def leaf_type(self, t: Token) -> str:
        if t.kind == "name":
            return {"True": "true", "False": "false", "None": "none"}.get(t.text, t.text if t.text in _WORDS else "identifier")
        if t.kind == "number":
            return "float" if any(c in t.text for c in ".jJ") or "e" in t.text.lower() and not t.text.lower().startswith("0x") else "integer"
        return super().leaf_type(t)

    def prefix(self) -> Node:
        start, t = self.begin(), self.tok
        if t is None or t.kind in ("NEWLINE", "INDENT", "DEDENT"):
            return Node("ERROR", start, start, self.source)
        if t.kind == "string":
            parts = [self.leaf()]
            while self.kind == "string":
                parts.append(self.leaf())
            return parts[0] if len(parts) == 1 else self.make("concatenated_string", start, parts)
        if t.kind == "name":
            if t.text == "lambda":
                self.i += 1
                params = self.parameters("", ":", "lambda_parameters") if not self.at(":") else None
                self.skip(":")
                body = self.expression(1)
                return self.make("lambda", start, [params, body], body=body)
            if t.text == "not":
                self.i += 1
                return self.make("not_operator", start, [self.expression(5)])
            if t.text == "await":
                self.i += 1
                return self.make("await", start, [self.expression(15)])
            if t.text == "yield":
                self.i += 1
                self.skip("from")
                empty = not self.tok or self.kind in ("NEWLINE", "INDENT", "DEDENT") or self.at(")", "]", "}", "=", ",")
                return self.make("yield", start, [] if empty else [self.expressions("expression_list")])
            return self.leaf()
        if t.text in ("-", "+", "~"):
            self.i += 1
            return self.make("unary_operator", start, [self.expression(13)])
        if t.text in ("*", "**"):
            return self.starred()
        if t.text == "(":
            return self.bracket("(", ")")
        if t.text == "[":
            return self.bracket("[", "]")
        if t.text == "{":
            return self.bracket("{", "}")
        return self.leaf()

    def bracket(self, opening: str, close: str) -> Node:
        start = self.begin()
        self.i += 1
        held, self.no_in = self.no_in, False
        items, commas, pairs, loops = [], False, False, False
        while self.tok and not self.at(close):
            before = self.i
            if self.kind in ("NEWLINE", "INDENT", "DEDENT"):
                break
            if self.skip(","):
                commas = True
                continue
            if self.at("for") or self.at("async"):
                loops = True
                items += self.comprehension()
                continue
            item = self.starred()
            if self.at(":") and opening == "{":
                self.i += 1
                value = self.expression()
                item = self.make("pair", item.start, [item, value], key=item, value=value)
                pairs = True
            pairs = pairs or item.type == "dictionary_splat"
            items.append(item)
            if self.i == before:
                items.append(self.leaf())
        self.no_in = held
        self.skip(close)
        if loops:
            kind = {"(": "generator_expression", "[": "list_comprehension"}.get(opening, "dictionary_comprehension" if pairs else "set_comprehension")
        elif opening == "(":
            kind = "tuple" if commas or not items else "parenthesized_expression"
        elif opening == "[":
            kind = "list"
        else:
            kind = "dictionary" if pairs or not items else "set"
        return self.make(kind, start, items)

    def comprehension(self) -> list[Node]:
        out = []
        while self.at("for", "async", "if"):
            start = self.begin()
            self.skip("async")
            if self.skip("if"):
                out.append(self.make("if_clause", start, [self.expression(2)]))
                continue
            self.i += 1
            self.no_in = True
            target = self.expressions("pattern_list")
            self.no_in = False
            self.skip("in")
            out.append(self.make("for_in_clause", start, [target, self.expression(2)]))
        return out

    def arguments(self) -> Node:
        start = self.begin()
        self.i += 1
        items = []
        held, self.no_in = self.no_in, False
        while self.tok and not self.at(")") and self.kind not in ("NEWLINE", "INDENT", "DEDENT"):
            before = self.i
            if self.skip(","):
                continue
            if self.kind == "name" and self.ahead() == "=" and self.ahead_kind() == "op":
                begin = self.begin()
                name = self.leaf("identifier")
                self.i += 1
                value = self.expression()
                items.append(self.make("keyword_argument", begin, [name, value], name=name, value=value))
            else:
                item = self.starred()
                if self.at("for", "async"):
                    item = self.make("generator_expression", item.start, [item, *self.comprehension()])
                items.append(item)
            if self.i == before:
                items.append(self.leaf())
        self.no_in = held
        self.skip(")")
        return self.make("argument_list", start, items)

    def postfix(self, left: Node) -> Node | None:
        if left.type == "ERROR" or self.kind != "op":
            return None
        if self.at("."):
            if self.ahead_kind() != "name":
                return None
            self.i += 1
            name = self.leaf("identifier")
            return self.make("attribute", left.start, [left, name], object=left, attribute=name)
        if self.at("("):
            args = self.arguments()
            return self.make("call", left.start, [left, args], function=left, arguments=args)
        if self.at("["):
            self.i += 1
            held, self.no_in = self.no_in, False
            kids = []
            while self.tok and not self.at("]") and self.kind not in ("NEWLINE", "INDENT", "DEDENT"):
                before = self.i
                if self.skip(",", ":"):
                    continue
                kids.append(self.starred())
                if self.i == before:
                    kids.append(self.leaf())
            self.no_in = held
            self.skip("]")
            return self.make("subscript", left.start, [left, *kids], value=left)
        return None
