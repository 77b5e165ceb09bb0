"""A tolerant parser of Go."""

from __future__ import annotations

from .node import MAX_DEPTH, Node, Parser, Token

_ASSIGN = {"=", ":=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", "&^="}
_KEYWORDS = {"break", "case", "chan", "const", "continue", "default", "defer", "else", "fallthrough", "for", "func", "go", "goto", "if", "import", "interface", "map", "package", "range", "return", "select", "struct", "switch", "type", "var"}


class GoParser(Parser):
    language = "go"
    string_type = "interpreted_string_literal"
    binary = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "+": 4, "-": 4, "|": 4, "^": 4, "*": 5, "/": 5, "%": 5, "<<": 5, ">>": 5, "&": 5, "&^": 5, "<-": 0}

    def __init__(self, text: str):
        super().__init__(text)
        #: Whether a brace after an expression may open a composite literal.
        self.literals = True

    def leaf_type(self, t: Token) -> str:
        if t.kind == "name":
            return t.text if t.text in ("true", "false", "nil", "iota") or t.text in _KEYWORDS else "identifier"
        if t.kind == "number":
            low = t.text.lower()
            return "imaginary_literal" if low[-1] == "i" else "float_literal" if "." in low or "e" in low and not low.startswith("0x") else "int_literal"
        if t.kind == "string":
            return {"`": "raw_string_literal", "'": "rune_literal"}.get(t.text[0], "interpreted_string_literal")
        return t.text

    def operator(self) -> str:
        # A line end closes an operand.
        return "" if self.line else super().operator()

    def parse(self) -> Node:
        kids = []
        while self.tok:
            before = self.i
            kids.append(self.statement())
            if self.i == before:
                kids.append(self.leaf())
        return Node("source_file", 0, len(self.source.text), self.source, kids)

    # -- declarations ---------------------------------------------------------------
    def import_(self) -> Node:
        start = self.begin()
        self.i += 1

        def spec() -> Node:
            b, name = self.begin(), None
            if self.at("."):
                name = self.leaf("dot")
            elif self.at("_"):
                name = self.leaf("blank_identifier")
            elif self.kind == "name":
                name = self.leaf("package_identifier")
            path = self.leaf() if self.kind == "string" else None
            return self.make("import_spec", b, [name, path], name=name, path=path)

        if self.at("("):
            b = self.begin()
            self.i += 1
            return self.make("import_declaration", start, [self.make("import_spec_list", b, self.listed(")", spec, ";"))])
        return self.make("import_declaration", start, [spec()])

    def group(self, kind: str, spec) -> Node:
        start = self.begin()
        self.i += 1
        if self.skip("("):
            return self.make(kind, start, self.listed(")", spec, ";"))
        return self.make(kind, start, [spec()])

    def value_spec(self, kind: str) -> Node:
        start, kids, values = self.begin(), [], None
        while self.kind == "name":
            kids.append(self.leaf("identifier"))
            if not self.skip(","):
                break
        if not self.line and not self.at("=", ")", ";"):
            kids.append(self.type_())
        if self.skip("="):
            values = self.expressions()
            kids.append(values)
        return self.make(kind, start, kids, name=kids[0] if kids else None, value=values)

    def type_spec(self) -> Node:
        start = self.begin()
        name = self.leaf("type_identifier") if self.kind == "name" else None
        params = None
        if self.at("[") and self.ahead_kind() == "name" and self.ahead(2) != "]":
            params = self.parameters("[", "]", "type_parameter_list")
        self.skip("=")
        t = self.type_()
        return self.make("type_spec", start, [name, params, t], name=name, type=t)

    def function(self) -> Node:
        start = self.begin()
        self.i += 1
        receiver = self.parameters() if self.at("(") else None
        name = self.leaf("field_identifier" if receiver else "identifier") if self.kind == "name" else None
        types = self.parameters("[", "]", "type_parameter_list") if self.at("[") else None
        params, result = self.signature()
        body = self.block() if self.at("{") else None
        return self.make("method_declaration" if receiver else "function_declaration", start, [receiver, name, types, params, result, body], receiver=receiver, name=name, type_parameters=types, parameters=params, result=result, body=body)

    def signature(self) -> tuple[Node | None, Node | None]:
        params = self.parameters() if self.at("(") else None
        result = None
        if self.at("("):
            result = self.parameters()
        elif self.tok and not self.line and not self.at("{", ")", ",", "]", "}", ";", "=", ":", ":=") and self.kind in ("name", "op"):
            result = self.type_()
        return params, result

    def parameters(self, opening: str = "(", close: str = ")", kind: str = "parameter_list") -> Node:
        start = self.begin()
        self.skip(opening)
        self.depth += 1
        groups: list[tuple[int, list]] = []
        while self.tok and not self.at(close):
            before, b = self.i, self.begin()
            if self.skip(",", ";"):
                continue
            if self.depth > MAX_DEPTH:
                self.i += 1
                continue
            parts = []
            if self.at("..."):
                self.i += 1
            parts.append(self.type_())
            if self.tok and not self.at(",", close):
                variadic = self.skip("...")
                parts.append(self.type_())
                if variadic:
                    parts[-1] = self.make("variadic", parts[-1].start, [parts[-1]])
                while self.at("|", "~"):
                    self.i += 1
                    if not self.at("~"):
                        parts.append(self.type_())
            groups.append((b, parts))
            if self.i == before:
                self.i += 1
        self.depth -= 1
        self.skip(close)
        out, named = [], any(len(p) > 1 for _, p in groups)
        pending: list[Node] = []
        for b, parts in groups:
            if named and len(parts) == 1 and parts[0].type == "type_identifier":
                pending.append(Node("identifier", parts[0].start, parts[0].end, self.source))
            elif named and parts[0].type == "type_identifier":
                names = [*pending, Node("identifier", parts[0].start, parts[0].end, self.source)]
                kids = [*names, *parts[1:]]
                out.append(Node("variadic_parameter_declaration" if parts[1].type == "variadic" else "parameter_declaration", names[0].start, parts[-1].end, self.source, kids, {"name": names[0], "type": parts[1]}))
                pending = []
            else:
                out.append(Node("parameter_declaration", b, parts[-1].end, self.source, [*pending, *parts], {"type": parts[-1]}))
                pending = []
        return self.make(kind, start, [*out, *pending])

    def type_(self) -> Node:
        self.depth += 1
        try:
            return self._type() if self.depth < MAX_DEPTH else (self.leaf() if self.tok else Node("ERROR", self.begin(), self.begin(), self.source))
        finally:
            self.depth -= 1

    def _type(self) -> Node:
        start = self.begin()
        if self.tok is None:
            return Node("ERROR", start, start, self.source)
        if self.at("*"):
            self.i += 1
            return self.make("pointer_type", start, [self.type_()])
        if self.at("("):
            self.i += 1
            t = self.type_()
            self.skip(")")
            return self.make("parenthesized_type", start, [t])
        if self.at("["):
            self.i += 1
            if self.skip("]"):
                return self.make("slice_type", start, [self.type_()])
            size = None if self.skip("...") else self.expression()
            self.skip("]")
            return self.make("array_type", start, [size, self.type_()])
        if self.at("map"):
            self.i += 1
            self.skip("[")
            key = self.type_()
            self.skip("]")
            return self.make("map_type", start, [key, self.type_()])
        if self.at("chan", "<-"):
            self.i += 1
            self.skip("chan", "<-")
            return self.make("channel_type", start, [self.type_()])
        if self.at("func"):
            self.i += 1
            return self.make("function_type", start, list(self.signature()))
        if self.at("struct"):
            self.i += 1
            b = self.begin()
            self.skip("{")
            return self.make("struct_type", start, [self.make("field_declaration_list", b, self.listed("}", self.field, ";"))])
        if self.at("interface"):
            self.i += 1
            self.skip("{")
            return self.make("interface_type", start, self.listed("}", self.method, ";", "|", "~"))
        if self.kind == "name":
            if self.ahead() == "." and self.ahead_kind(2) == "name":
                pkg = self.leaf("package_identifier")
                self.i += 1
                n = self.make("qualified_type", start, [pkg, self.leaf("type_identifier")])
            else:
                n = self.leaf("type_identifier")
            if self.at("[") and self.ahead() != "]" and not self.line and self._types_inside():
                b = self.begin()
                self.i += 1
                n = self.make("generic_type", start, [n, self.make("type_arguments", b, self.listed("]", self.type_))])
            return n
        return self.leaf()

    def _types_inside(self) -> bool:
        """Whether the brackets hold types: names, then what can follow a type."""
        j, depth = self.i, 0
        while j < len(self.toks):
            t = self.toks[j]
            depth += t.text == "["
            depth -= t.text == "]"
            if t.kind not in ("name",) and t.text not in ("[", "]", ",", ".", "*"):
                return False
            j += 1
            if not depth:
                return j < len(self.toks) and self.toks[j].text in ("{", ")", ",", "(", "}", "]") or j >= len(self.toks) or self.toks[j].line
        return False

    def field(self) -> Node:
        start, kids = self.begin(), []
        if self.at("*") or self.kind == "name" and (self.ahead() == "." or self.i + 1 < len(self.toks) and self.toks[self.i + 1].line or self.ahead_kind() == "string" or self.ahead() == "}"):
            kids.append(self.type_())
        else:
            while self.kind == "name":
                kids.append(self.leaf("field_identifier"))
                if not self.skip(","):
                    break
            kids.append(self.type_())
        if self.kind == "string" and not self.line:
            kids.append(self.leaf())
        return self.make("field_declaration", start, kids)

    def method(self) -> Node:
        start = self.begin()
        if self.kind == "name" and self.ahead() == "(":
            name = self.leaf("field_identifier")
            return self.make("method_elem", start, [name, *self.signature()])
        return self.type_()

    # -- statements -------------------------------------------------------------------
    def block(self) -> Node:
        start, kids = self.begin(), []
        if not self.skip("{"):
            return Node("block", start, start, self.source)
        held, self.literals = self.literals, True
        while self.tok and not self.at("}"):
            before = self.i
            kids.append(self.statement())
            if self.i == before:
                kids.append(self.leaf())
        self.literals = held
        self.skip("}")
        return self.make("block", start, kids)

    def statement(self) -> Node:
        self.depth += 1
        try:
            if self.depth > MAX_DEPTH and self.at("{"):
                return self.flat("ERROR", "}")
            return self._statement()
        finally:
            self.depth -= 1

    def _statement(self) -> Node:
        start, t = self.begin(), self.text if self.kind in ("name", "op") else ""
        if t == ";":
            return self.leaf(";")
        if t == "{":
            return self.block()
        if t == "package":
            self.i += 1
            return self.make("package_clause", start, [self.leaf("package_identifier")] if self.kind == "name" else [])
        if t == "import":
            return self.import_()
        if t == "func" and (self.ahead_kind() == "name" or self.ahead() == "(" and self._method()):
            return self.function()
        if t == "var":
            return self.group("var_declaration", lambda: self.value_spec("var_spec"))
        if t == "const":
            return self.group("const_declaration", lambda: self.value_spec("const_spec"))
        if t == "type":
            return self.group("type_declaration", self.type_spec)
        if t in ("if", "for", "switch", "select"):
            return self.controlled(t)
        if t in ("go", "defer"):
            self.i += 1
            return self.make(f"{t}_statement", start, [self.expression()])
        if t in ("return", "break", "continue", "goto", "fallthrough"):
            self.i += 1
            kids = [] if self.line or not self.tok or self.at("}", ";") else [self.expressions()]
            return self.make(f"{t}_statement", start, kids)
        if self.kind == "name" and self.ahead() == ":" and t not in ("case", "default") and t not in _KEYWORDS:
            label = self.leaf("label_name")
            self.i += 1
            return self.make("labeled_statement", start, [label])
        return self.simple()

    def _method(self) -> bool:
        """Whether what stands in parentheses after func is a receiver."""
        j, depth = self.i + 1, 0
        while j < len(self.toks):
            depth += self.toks[j].text == "("
            depth -= self.toks[j].text == ")"
            j += 1
            if not depth:
                break
        return j + 1 < len(self.toks) and self.toks[j].kind == "name" and self.toks[j + 1].text in ("(", "[")

    def simple(self) -> Node:
        start = self.begin()
        left = self.expressions()
        if self.text in _ASSIGN and self.kind == "op":
            op = self.text
            self.i += 1
            if self.at("range"):
                self.i += 1
                right = self.expression()
                return self.make("range_clause", start, [left, right], left=left, right=right)
            right = self.expressions()
            return self.make("short_var_declaration" if op == ":=" else "assignment_statement", start, [left, right], left=left, right=right)
        if self.at("++", "--"):
            op = self.leaf().text
            return self.make("inc_statement" if op == "++" else "dec_statement", start, [left])
        if self.at("<-") and not self.line:
            self.i += 1
            return self.make("send_statement", start, [left, self.expression()])
        return left if left.type != "expression_list" else self.make("expression_statement", start, [left])

    def controlled(self, word: str) -> Node:
        start, kids = self.begin(), []
        self.i += 1
        held, self.literals = self.literals, False
        while self.tok and not self.at("{"):
            before = self.i
            if self.skip(";"):
                continue
            if self.at("range"):
                self.i += 1
                kids.append(self.expression())
            else:
                kids.append(self.simple() if not self.at("var") else self.statement())
            if self.i == before:
                kids.append(self.leaf())
        self.literals = held
        if word in ("switch", "select"):
            self.skip("{")
            while self.tok and not self.at("}"):
                before = self.i
                if self.skip("case"):
                    kids.append(self.simple_case())
                    self.skip(":")
                elif self.skip("default"):
                    self.skip(":")
                else:
                    kids.append(self.statement())
                if self.i == before:
                    kids.append(self.leaf())
            self.skip("}")
            return self.make(f"{'expression_switch' if word == 'switch' else word}_statement", start, kids)
        kids.append(self.block())
        if word == "if" and self.skip("else"):
            kids.append(self.statement())
        return self.make(f"{word}_statement", start, kids)

    def simple_case(self) -> Node:
        """The values of a case; types read as expressions."""
        start, kids = self.begin(), []
        while self.tok and not self.at(":"):
            before = self.i
            if self.skip(","):
                continue
            kids.append(self.type_() if self.at("*", "[", "map", "func", "chan", "struct", "interface") else self.simple())
            if self.i == before:
                kids.append(self.leaf())
        return self.make("expression_list", start, kids)

    # -- expressions ------------------------------------------------------------------
    def expressions(self) -> Node:
        start, items = self.begin(), [self.expression()]
        while self.skip(","):
            items.append(self.expression())
        return items[0] if len(items) == 1 else self.make("expression_list", start, items)

    def prefix(self) -> Node:
        start, t = self.begin(), self.tok
        if t is None:
            return Node("ERROR", start, start, self.source)
        if t.text in ("-", "+", "!", "^", "&", "*", "<-") and t.kind == "op":
            self.i += 1
            return self.make("unary_expression", start, [self.expression(6)])
        if t.text == "(":
            self.i += 1
            held, self.literals = self.literals, True
            inner = self.expression()
            self.literals = held
            self.skip(")")
            return self.make("parenthesized_expression", start, [inner])
        if t.kind == "name" and t.text == "func":
            self.i += 1
            params, result = self.signature()
            body = self.block() if self.at("{") else None
            return self.make("func_literal", start, [params, result, body], body=body)
        if t.text in ("[", "map", "chan", "struct", "interface") and t.kind in ("op", "name"):
            ty = self.type_()
            if self.at("{"):
                body = self.literal()
                return self.make("composite_literal", start, [ty, body], type=ty, body=body)
            if self.at("("):
                self.i += 1
                value = self.expression()
                self.skip(")")
                return self.make("type_conversion_expression", start, [ty, value])
            return ty
        return self.leaf()

    def literal(self) -> Node:
        """The braces of a composite literal."""
        start = self.begin()
        self.skip("{")
        held, self.literals = self.literals, True
        self.depth += 1

        def one() -> Node:
            b = self.begin()
            if self.depth > MAX_DEPTH:
                return self.leaf()
            item = self.literal() if self.at("{") else self.expression()
            if self.skip(":"):
                value = self.literal() if self.at("{") else self.expression()
                return self.make("keyed_element", b, [item, value])
            return self.make("literal_element", b, [item])

        items = self.listed("}", one)
        self.depth -= 1
        self.literals = held
        return self.make("literal_value", start, items)

    def postfix(self, left: Node) -> Node | None:
        if left.type == "ERROR" or self.kind != "op" or self.line and not self.at("."):
            return None
        if self.at("."):
            if self.ahead() == "(":
                self.i += 2
                t = self.leaf("type") if self.at("type") else self.type_()
                self.skip(")")
                return self.make("type_assertion_expression", left.start, [left, t])
            if self.ahead_kind() != "name":
                return None
            self.i += 1
            name = self.leaf("field_identifier")
            return self.make("selector_expression", left.start, [left, name], operand=left, field=name)
        if self.at("("):
            start = self.begin()
            self.i += 1
            held, self.literals = self.literals, True
            special = left.type == "identifier" and left.text in ("make", "new")
            args = []
            if special and self.tok and not self.at(")"):
                args.append(self.type_())
            args += self.listed(")", self.expression, "...")
            self.literals = held
            arguments = self.make("argument_list", start, args)
            return self.make("call_expression", left.start, [left, arguments], function=left, arguments=arguments)
        if self.at("["):
            self.i += 1
            held, self.literals = self.literals, True
            kids, colon = [], False
            while self.tok and not self.at("]"):
                before = self.i
                if self.skip(","):
                    continue
                if self.skip(":"):
                    colon = True
                    continue
                kids.append(self.expression() if not self.at("*", "map", "[") else self.type_())
                if self.i == before:
                    kids.append(self.leaf())
            self.literals = held
            self.skip("]")
            return self.make("slice_expression" if colon else "index_expression", left.start, [left, *kids], operand=left)
        if self.at("{") and self.literals and left.type in ("identifier", "selector_expression", "index_expression"):
            # A type name: its parts are types, not values.
            if left.type == "identifier":
                left.type = "type_identifier"
            elif left.type == "selector_expression" and left.kids[0].type == "identifier":
                left.kids[0].type, left.kids[1].type, left.type = "package_identifier", "type_identifier", "qualified_type"
            body = self.literal()
            return self.make("composite_literal", left.start, [left, body], type=left, body=body)
        return None
