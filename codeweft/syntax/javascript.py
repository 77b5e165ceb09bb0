"""A tolerant parser of JavaScript."""

from __future__ import annotations

import re

from .node import MAX_DEPTH, Node, Parser, Token, scan

_ASSIGN = {"+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??="}
_UNARY = {"!", "~", "-", "+", "typeof", "void", "delete"}
_KEYWORDS = {"if", "else", "for", "while", "do", "switch", "case", "default", "return", "throw", "try", "catch", "finally", "break", "continue", "var", "let", "const", "function", "class", "import", "export", "new", "in", "instanceof", "typeof", "void", "delete", "extends"}
_HOLE = re.compile(r"\\.|\$\{", re.S)


class JavaScriptParser(Parser):
    language = "javascript"
    binary = {"=": 1, **dict.fromkeys(_ASSIGN, 1), "?": 2, "??": 3, "||": 4, "&&": 5, "|": 6, "^": 7, "&": 8, "==": 9, "!=": 9, "===": 9, "!==": 9, "<": 10, ">": 10, "<=": 10, ">=": 10, "in": 10, "instanceof": 10, "<<": 11, ">>": 11, ">>>": 11, "+": 12, "-": 12, "*": 13, "/": 13, "%": 13, "**": 14}

    def parse(self) -> Node:
        kids = []
        while self.tok:
            before = self.i
            kids.append(self.statement())
            if self.i == before:
                kids.append(self.leaf())
        return Node("program", 0, len(self.source.text), self.source, kids)

    # -- statements -------------------------------------------------------------------
    def statement(self) -> Node:
        self.depth += 1
        try:
            return self.flat("ERROR", "}") if self.depth > MAX_DEPTH and self.at("{") else self._statement()
        finally:
            self.depth -= 1

    def _statement(self) -> Node:
        start, t = self.begin(), self.text if self.kind in ("name", "op") else ""
        if t == "{":
            return self.block()
        if t == ";":
            return self.leaf("empty_statement")
        if t == "import" and self.ahead() not in ("(", "."):
            return self.import_()
        if t == "export":
            return self.export()
        if t in ("const", "let") and (self.ahead_kind() == "name" or self.ahead() in ("{", "[")) or t == "var":
            return self.declaration()
        if t == "function" or t == "async" and self.ahead() == "function" and not self.toks[self.i + 1].line:
            return self.function("function_declaration", "generator_function_declaration")
        if t == "class":
            return self.class_("class_declaration")
        if t.startswith("@") and self.kind == "name":
            return self.decorated()
        if t in ("if", "while", "switch", "with"):
            self.i += 1
            test = self.parenthesised()
            if t == "switch":
                return self.make("switch_statement", start, [test, self.cases()])
            kids = [test, self.statement()]
            if t == "if" and self.at("else"):
                begin = self.begin()
                self.i += 1
                kids.append(self.make("else_clause", begin, [self.statement()]))
            return self.make(f"{t}_statement", start, kids)
        if t == "for":
            return self.for_()
        if t == "do":
            self.i += 1
            kids = [self.statement()]
            if self.skip("while"):
                kids.append(self.parenthesised())
            self.skip(";")
            return self.make("do_statement", start, kids)
        if t == "try":
            self.i += 1
            kids = [self.block()]
            if self.at("catch"):
                begin = self.begin()
                self.i += 1
                param = None
                if self.skip("("):
                    param = self.pattern()
                    self.skip(")")
                kids.append(self.make("catch_clause", begin, [param, self.block()]))
            if self.at("finally"):
                begin = self.begin()
                self.i += 1
                kids.append(self.make("finally_clause", begin, [self.block()]))
            return self.make("try_statement", start, kids)
        if t in ("return", "throw", "break", "continue"):
            self.i += 1
            kids = []
            if self.tok and not self.line and not self.at(";", "}"):
                kids.append(self.sequence())
            self.skip(";")
            return self.make(f"{t}_statement", start, kids)
        if self.kind == "name" and self.ahead() == ":" and t not in _KEYWORDS:
            label = self.leaf("statement_identifier")
            self.i += 1
            return self.make("labeled_statement", start, [label, self.statement()])
        inner = self.sequence()
        self.skip(";")
        return self.make("expression_statement", start, [inner])

    def block(self) -> Node:
        start, kids = self.begin(), []
        if not self.skip("{"):
            return Node("statement_block", start, start, self.source)
        while self.tok and not self.at("}"):
            before = self.i
            kids.append(self.statement())
            if self.i == before:
                kids.append(self.leaf())
        self.skip("}")
        return self.make("statement_block", start, kids)

    def cases(self) -> Node:
        start, kids = self.begin(), []
        self.skip("{")
        while self.tok and not self.at("}"):
            before = self.i
            if self.skip("case"):
                kids.append(self.sequence())
                self.skip(":")
            elif self.skip("default"):
                self.skip(":")
            else:
                kids.append(self.statement())
            if self.i == before:
                kids.append(self.leaf())
        self.skip("}")
        return self.make("switch_body", start, kids)

    def for_(self) -> Node:
        start, kids, kind = self.begin(), [], "for_statement"
        self.i += 1
        self.skip("await")
        if self.skip("("):
            while self.tok and not self.at(")"):
                before = self.i
                if self.at("of", "in"):
                    kind = "for_in_statement"
                    self.i += 1
                    kids.append(self.sequence())
                elif self.skip(";"):
                    continue
                elif self.at("var", "let", "const"):
                    if kind == "for_statement" and self._loops_over():
                        self.i += 1
                        kids.append(self.pattern())
                    else:
                        kids.append(self.declaration(loop=True))
                else:
                    kids.append(self.sequence(no_in=True))
                if self.i == before:
                    kids.append(self.leaf())
            self.skip(")")
        kids.append(self.statement())
        return self.make(kind, start, kids)

    def _loops_over(self) -> bool:
        j, depth = self.i + 1, 0
        while j < len(self.toks):
            t = self.toks[j].text
            depth += t in ("(", "[", "{")
            depth -= t in (")", "]", "}")
            if depth < 0 or t in (";", "=") and not depth:
                return False
            if t in ("of", "in") and not depth:
                return True
            j += 1
        return False

    def declaration(self, loop: bool = False) -> Node:
        start = self.begin()
        word = self.leaf().text
        kids = []
        while self.tok:
            begin = self.begin()
            name = self.pattern()
            value = None
            if self.skip("="):
                value = self.expression()
            kids.append(self.make("variable_declarator", begin, [name, value], name=name, value=value))
            if not self.skip(","):
                break
        if not loop:
            self.skip(";")
        return self.make("variable_declaration" if word == "var" else "lexical_declaration", start, kids)

    def import_(self) -> Node:
        start = self.begin()
        self.i += 1
        clause, begin = [], self.begin()
        while self.tok and self.kind != "string" and not self.at(";", "from"):
            if self.at("*"):
                b = self.begin()
                self.i += 1
                self.skip("as")
                name = self.leaf("identifier") if self.kind == "name" else None
                clause.append(self.make("namespace_import", b, [name], name=name))
            elif self.at("{"):
                clause.append(self.specifiers("named_imports", "import_specifier"))
            elif self.kind == "name":
                clause.append(self.leaf("identifier"))
            elif not self.skip(","):
                break
        holder = self.make("import_clause", begin, clause) if clause else None
        self.skip("from")
        source = self.leaf() if self.kind == "string" else None
        self.skip(";")
        return self.make("import_statement", start, [holder, source], clause=holder, source=source)

    def specifiers(self, kind: str, item: str) -> Node:
        start = self.begin()
        self.skip("{")

        def one() -> Node:
            b = self.begin()
            name = self.leaf("string" if self.kind == "string" else "identifier")
            alias = None
            if self.skip("as") and self.kind in ("name", "string"):
                alias = self.leaf("identifier")
            return self.make(item, b, [name, alias], name=name, alias=alias)

        return self.make(kind, start, self.listed("}", one))

    def export(self) -> Node:
        start = self.begin()
        self.i += 1
        self.skip("default")
        if self.at("{", "*"):
            if self.skip("*"):
                kids = [self.leaf("identifier")] if self.skip("as") and self.kind == "name" else []
            else:
                kids = [self.specifiers("export_clause", "export_specifier")]
            if self.skip("from") and self.kind == "string":
                kids.append(self.leaf())
            self.skip(";")
            return self.make("export_statement", start, kids)
        if self.at("class", "function", "const", "let", "var", "async") or self.text.startswith("@"):
            inner = self.statement()
        else:
            inner = self.sequence()
            self.skip(";")
        return self.make("export_statement", start, [inner])

    def decorated(self) -> Node:
        marks = self.decorators()
        if self.at("export"):
            n = self.export()
        elif self.at("class"):
            n = self.class_("class_declaration")
        else:
            return self.make("ERROR", marks[0].start, marks)
        for m in marks:
            m.parent = n
        n.kids = [*marks, *n.kids]
        n.start = marks[0].start
        return n

    def decorators(self) -> list[Node]:
        out = []
        while self.kind == "name" and self.text.startswith("@"):
            t = self.tok
            self.i += 1
            value = Node("identifier", t.start + 1, t.end, self.source)
            while (more := self.postfix(value)) is not None and not self.line:
                value = more
            out.append(Node("decorator", t.start, value.end, self.source, [value], {"value": value}))
        return out

    def function(self, plain: str, generator: str) -> Node:
        start = self.begin()
        sign = [self.leaf("async")] if self.at("async") else []
        self.skip("function")
        star = self.skip("*")
        name = self.leaf("identifier") if self.kind == "name" else None
        params = self.parameters() if self.at("(") else None
        body = self.block()
        return self.make(generator if star else plain, start, [*sign, name, params, body], name=name, parameters=params, body=body)

    def parameters(self) -> Node:
        start = self.begin()
        self.skip("(")
        return self.make("formal_parameters", start, self.listed(")", self.parameter))

    def parameter(self) -> Node:
        start = self.begin()
        marks = self.decorators()
        if self.skip("..."):
            return self.make("rest_pattern", start, [*marks, self.pattern()])
        p = self.pattern()
        if self.skip("="):
            value = self.expression()
            return self.make("assignment_pattern", start, [*marks, p, value], left=p, right=value)
        return p

    def pattern(self) -> Node:
        start = self.begin()
        if self.at("["):
            self.i += 1
            return self.make("array_pattern", start, self.listed("]", self.parameter))
        if self.at("{"):
            self.i += 1
            return self.make("object_pattern", start, self.listed("}", self._field))
        if self.kind == "name":
            return self.leaf("identifier")
        return self.leaf("ERROR") if self.tok else Node("ERROR", start, start, self.source)

    def _field(self) -> Node:
        start = self.begin()
        if self.skip("..."):
            return self.make("rest_pattern", start, [self.pattern()])
        if self.kind == "name" and self.ahead() in (",", "}"):
            return self.leaf("shorthand_property_identifier_pattern")
        if self.kind == "name" and self.ahead() == "=":
            name = self.leaf("shorthand_property_identifier_pattern")
            self.i += 1
            return self.make("object_assignment_pattern", start, [name, self.expression()])
        key = self.key()
        if self.skip(":"):
            value = self.parameter()
            return self.make("pair_pattern", start, [key, value], key=key, value=value)
        return key

    def key(self) -> Node:
        start = self.begin()
        if self.at("["):
            self.i += 1
            inner = self.expression()
            self.skip("]")
            return self.make("computed_property_name", start, [inner])
        if self.kind == "name":
            return self.leaf("private_property_identifier" if self.text.startswith("#") else "property_identifier")
        return self.leaf()

    def class_(self, kind: str) -> Node:
        start = self.begin()
        self.skip("class")
        name = self.leaf("identifier") if self.kind == "name" and not self.at("extends") else None
        heritage = None
        if self.at("extends"):
            begin = self.begin()
            self.i += 1
            heritage = self.make("class_heritage", begin, [self.expression(14)])
        begin, members = self.begin(), []
        if self.skip("{"):
            while self.tok and not self.at("}"):
                before = self.i
                if self.skip(";"):
                    continue
                members.append(self.member())
                if self.i == before:
                    members.append(self.leaf())
            self.skip("}")
        body = self.make("class_body", begin, members)
        return self.make(kind, start, [name, heritage, body], name=name, body=body)

    def member(self) -> Node:
        """A method or a field of a class, or a method of an object."""
        start = self.begin()
        marks = self.decorators()
        signs = []
        if self.at("static") and self.ahead() == "{":
            self.i += 1
            return self.make("class_static_block", start, [*marks, self.block()])
        while self.kind == "name" and self.text in ("static", "async", "get", "set") and self.ahead() not in ("(", "=", ";", ",", "}", ":"):
            signs.append(self.leaf(self.text))
        if self.at("*"):
            signs.append(self.leaf("*"))
        name = self.key()
        if self.at("("):
            params = self.parameters()
            body = self.block()
            return self.make("method_definition", start, [*marks, *signs, name, params, body], name=name, parameters=params, body=body)
        value = self.expression() if self.skip("=") else None
        self.skip(";")
        return self.make("field_definition", start, [*marks, *signs, name, value], property=name, value=value)

    # -- expressions --------------------------------------------------------------------
    def leaf_type(self, t: Token) -> str:
        if t.kind == "name":
            return t.text if t.text in ("true", "false", "null", "undefined", "this", "super") or t.text in _KEYWORDS else "identifier"
        return t.kind if t.kind in ("number", "regex") else super().leaf_type(t)

    def sequence(self, no_in: bool = False) -> Node:
        held, self.no_in = getattr(self, "no_in", False), no_in
        start, items = self.begin(), [self.expression()]
        while self.skip(","):
            items.append(self.expression())
        self.no_in = held
        return items[0] if len(items) == 1 else self.make("sequence_expression", start, items)

    def parenthesised(self) -> Node:
        start = self.begin()
        if not self.skip("("):
            return Node("ERROR", start, start, self.source)
        kids = [] if self.at(")") else [self.sequence()]
        while self.tok and not self.at(")"):
            kids.append(self.leaf())
        self.skip(")")
        return self.make("parenthesized_expression", start, kids)

    def operator(self) -> str:
        op = super().operator()
        return "" if op == "in" and getattr(self, "no_in", False) else op

    def take_operator(self, op: str) -> list[Node]:
        sign = [self.leaf(op)]
        if op == "?":
            middle = self.expression()
            self.skip(":")
            return [middle]
        return sign

    def make(self, kind: str, start: int, kids: list, **fields) -> Node:
        if kind == "ternary_expression":
            fields = {"condition": kids[0], "consequence": kids[1], "alternative": kids[-1]}
        return super().make(kind, start, kids, **fields)

    def binary_type(self, op: str) -> str:
        return "assignment_expression" if op == "=" else "augmented_assignment_expression" if op in _ASSIGN else "ternary_expression" if op == "?" else "binary_expression"

    def arrow(self) -> bool:
        """Whether an arrow function begins here."""
        j = self.i + (self.at("async") and not (self.ahead() == "=>"))
        if j >= len(self.toks):
            return False
        if self.toks[j].kind == "name" and j + 1 < len(self.toks) and self.toks[j + 1].text == "=>":
            return True
        if self.toks[j].text != "(":
            return False
        depth = 0
        while j < len(self.toks):
            depth += self.toks[j].text in ("(", "[", "{")
            depth -= self.toks[j].text in (")", "]", "}")
            j += 1
            if not depth:
                return j < len(self.toks) and self.toks[j].text == "=>"
        return False

    def prefix(self) -> Node:
        start, t = self.begin(), self.tok
        if t is None:
            return Node("ERROR", start, start, self.source)
        if t.kind == "string":
            return self.template() if t.text[0] == "`" else self.leaf()
        if t.text in ("(", "async") or t.kind == "name" and self.ahead() == "=>":
            if self.arrow():
                sign = [self.leaf("async")] if self.at("async") and self.ahead() != "=>" else []
                params = self.parameters() if self.at("(") else self.leaf("identifier")
                self.skip("=>")
                body = self.block() if self.at("{") else self.expression()
                return self.make("arrow_function", start, [*sign, params, body], parameters=params, body=body)
            if t.text == "(":
                return self.parenthesised()
        if t.kind == "name":
            if t.text == "function" or t.text == "async" and self.ahead() == "function":
                return self.function("function_expression", "generator_function")
            if t.text == "class":
                return self.class_("class")
            if t.text == "new":
                self.i += 1
                if self.skip("."):
                    return self.make("meta_property", start, [self.leaf("property_identifier")])
                made = self.prefix()
                while self.at(".", "[") and (more := self.postfix(made)) is not None:
                    made = more
                args = self.arguments() if self.at("(") else None
                return self.make("new_expression", start, [made, args], constructor=made, arguments=args)
            if t.text == "await":
                self.i += 1
                return self.make("await_expression", start, [self.expression(14)])
            if t.text == "yield":
                self.i += 1
                self.skip("*")
                return self.make("yield_expression", start, [] if self.line or self.at(")", "]", "}", ",", ";") else [self.expression()])
            if t.text == "import":
                return self.leaf("import")
            if t.text in _UNARY:
                self.i += 1
                return self.make("unary_expression", start, [self.expression(14)])
            return self.leaf()
        if t.text in _UNARY:
            self.i += 1
            return self.make("unary_expression", start, [self.expression(14)])
        if t.text in ("++", "--"):
            self.i += 1
            return self.make("update_expression", start, [self.expression(14)])
        if t.text == "...":
            self.i += 1
            return self.make("spread_element", start, [self.expression()])
        if t.text == "[":
            self.i += 1
            return self.make("array", start, self.listed("]", self.expression))
        if t.text == "{":
            self.i += 1
            return self.make("object", start, self.listed("}", self._entry))
        if t.text == "<" and (self.ahead_kind() == "name" or self.ahead() == ">"):
            return self.jsx()
        return self.leaf()

    def _entry(self) -> Node:
        start = self.begin()
        if self.at("..."):
            return self.prefix()
        if self.kind == "name" and self.ahead() in (",", "}"):
            return self.leaf("shorthand_property_identifier")
        if self.kind == "name" and self.text in ("get", "set", "async", "static") and self.ahead() not in (":", "(", ",", "}"):
            return self.member()
        j = self.i
        if self.at("*"):
            return self.member()
        key = self.key()
        if self.at("("):
            self.i = j
            return self.member()
        if self.skip(":"):
            value = self.expression()
            return self.make("pair", start, [key, value], key=key, value=value)
        if self.skip("="):
            return self.make("object_assignment_pattern", start, [key, self.expression()])
        return key

    def template(self) -> Node:
        t = self.tok
        self.i += 1
        kids, at = [], 1
        while (m := _HOLE.search(t.text, at)) is not None:
            at = m.end()
            if m.group() != "${":
                continue
            depth, stop = 1, at
            while stop < len(t.text) and depth:
                depth += t.text[stop] == "{"
                depth -= t.text[stop] == "}"
                stop += 1
            kids.append(self._inner("template_substitution", t.start + at, t.start + stop - 1))
            at = stop
        return Node("template_string", t.start, t.end, self.source, kids)

    def _inner(self, kind: str, start: int, end: int) -> Node:
        """An expression within a template, parsed by the same rules."""
        held, self.depth = (self.toks, self.i), self.depth + 5
        shifted = []
        if self.depth <= MAX_DEPTH:
            for x in scan(self.source.text[start:end], self.language):
                if x.kind not in ("ws", "comment", "nl"):
                    shifted.append(Token(x.kind, x.text, x.start + start, x.end + start, x.line))
        self.toks, self.i = shifted, 0
        kids = [self.sequence()] if shifted else []
        while self.tok:
            kids.append(self.leaf())
        (self.toks, self.i), self.depth = held, self.depth - 5
        return Node(kind, start, end, self.source, kids)

    def jsx(self) -> Node:
        """An element: its name, attributes, children; text between is left out."""
        start = self.begin()
        self.i += 1
        kids: list[Node] = []
        name = self._jsx_name()
        if name is not None:
            kids.append(name)
        while self.tok and not self.at(">", "/"):
            before = self.i
            if self.at("{"):
                kids.append(self._jsx_hole())
            elif self.kind == "name":
                kids.append(self.leaf("property_identifier"))
                while self.at("-", ":"):
                    self.i += 2
                if self.skip("="):
                    kids.append(self._jsx_hole() if self.at("{") else self.leaf())
            if self.i == before:
                self.i += 1
        if self.skip("/"):
            self.skip(">")
            return self.make("jsx_self_closing_element", start, kids)
        self.skip(">")
        while self.tok:
            if self.at("<") and self.ahead() == "/":
                self.i += 2
                closing = self._jsx_name()
                if closing is not None:
                    kids.append(closing)
                self.skip(">")
                break
            if self.at("<"):
                self.depth += 1
                kids.append(self.jsx() if self.depth < MAX_DEPTH else self.leaf())
                self.depth -= 1
            elif self.at("{"):
                kids.append(self._jsx_hole())
            else:
                self.i += 1
        return self.make("jsx_element", start, kids)

    def _jsx_name(self) -> Node | None:
        if self.kind != "name":
            return None
        n = self.leaf("identifier")
        while self.at(".") and self.ahead_kind() == "name":
            self.i += 1
            p = self.leaf("property_identifier")
            n = self.make("member_expression", n.start, [n, p], object=n, property=p)
        return n

    def _jsx_hole(self) -> Node:
        start = self.begin()
        self.skip("{")
        kids = [] if self.at("}") else [self.sequence()]
        while self.tok and not self.at("}"):
            kids.append(self.leaf())
        self.skip("}")
        return self.make("jsx_expression", start, kids)

    def arguments(self) -> Node:
        start = self.begin()
        self.skip("(")
        held, self.no_in = getattr(self, "no_in", False), False
        items = self.listed(")", self.expression)
        self.no_in = held
        return self.make("arguments", start, items)

    def postfix(self, left: Node) -> Node | None:
        if left.type in ("ERROR", "arrow_function") or self.kind == "string" and self.text[0] != "`" or self.kind not in ("op", "string"):
            return None
        if self.at(".", "?."):
            if self.ahead_kind() == "name":
                self.i += 1
                name = self.leaf("private_property_identifier" if self.text.startswith("#") else "property_identifier")
                return self.make("member_expression", left.start, [left, name], object=left, property=name)
            if self.text == "?." and self.ahead() in ("(", "["):
                self.i += 1
            else:
                return None
        if self.at("("):
            args = self.arguments()
            return self.make("call_expression", left.start, [left, args], function=left, arguments=args)
        if self.at("["):
            self.i += 1
            index = self.sequence()
            self.skip("]")
            return self.make("subscript_expression", left.start, [left, index], object=left, index=index)
        if self.kind == "string":
            t = self.template()
            return self.make("call_expression", left.start, [left, t], function=left, arguments=t)
        if self.at("++", "--") and not self.line:
            self.i += 1
            return self.make("update_expression", left.start, [left])
        return None
