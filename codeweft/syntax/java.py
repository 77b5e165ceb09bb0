"""A tolerant parser of Java."""

from __future__ import annotations

from .node import MAX_DEPTH, Node, Parser, Token

_MODIFIERS = {"public", "private", "protected", "static", "final", "abstract", "native", "synchronized", "transient", "volatile", "strictfp", "default", "sealed", "non-sealed"}
_PRIMITIVE = {"int": "integral_type", "long": "integral_type", "short": "integral_type", "byte": "integral_type", "char": "integral_type", "float": "floating_point_type", "double": "floating_point_type", "boolean": "boolean_type", "void": "void_type"}
_STATEMENTS = {"if", "while", "for", "do", "switch", "try", "return", "throw", "break", "continue", "synchronized", "assert", "yield", "else", "case", "default", "catch", "finally"}
_ASSIGN = ("=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", ">>>=")


class JavaParser(Parser):
    language = "java"
    string_type = "string_literal"
    binary = {**dict.fromkeys(_ASSIGN, 1), "?": 2, "||": 3, "&&": 4, "|": 5, "^": 6, "&": 7, "==": 8, "!=": 8, "<": 9, ">": 9, "<=": 9, ">=": 9, "instanceof": 9, "<<": 10, ">>": 10, "+": 11, "-": 11, "*": 12, "/": 12, "%": 12}

    def leaf_type(self, t: Token) -> str:
        if t.kind == "name":
            return {"null": "null_literal", "true": "true", "false": "false", "this": "this", "super": "super"}.get(t.text, "identifier")
        if t.kind == "number":
            low = t.text.lower()
            if low.startswith("0x"):
                return "hex_integer_literal"
            if low.startswith("0b"):
                return "binary_integer_literal"
            return "decimal_floating_point_literal" if "." in low or low[-1] in "fd" or "e" in low else "decimal_integer_literal"
        if t.kind == "string":
            return "character_literal" if t.text[0] == "'" else "string_literal"
        return t.text

    def parse(self) -> Node:
        kids = []
        while self.tok:
            before = self.i
            kids.append(self.declaration(None) if self._declares() else self.statement())
            if self.i == before:
                kids.append(self.leaf())
        return Node("program", 0, len(self.source.text), self.source, kids)

    # -- declarations ---------------------------------------------------------------
    def _declares(self) -> bool:
        """Whether an import, a type or a package begins here, after modifiers."""
        j = self._past_modifiers(self.i)
        t = self.toks[j].text if j < len(self.toks) else ""
        if t in ("record", "enum"):
            return j + 1 < len(self.toks) and self.toks[j + 1].kind == "name"
        return t in ("import", "package", "class", "interface") or t == "@" and j + 1 < len(self.toks) and self.toks[j + 1].text == "interface"

    def _past_modifiers(self, j: int) -> int:
        while j < len(self.toks):
            t = self.toks[j].text
            if t in _MODIFIERS and not (t in ("default", "synchronized") and j + 1 < len(self.toks) and self.toks[j + 1].text in (":", "->", "(")):
                j += 1
            elif t == "@" and j + 1 < len(self.toks) and self.toks[j + 1].kind == "name" and self.toks[j + 1].text != "interface":
                j += 2
                while j + 1 < len(self.toks) and self.toks[j].text == ".":
                    j += 2
                if j < len(self.toks) and self.toks[j].text == "(":
                    j = self._past(j, "(", ")")
            else:
                break
        return j

    def _past(self, j: int, opening: str, close: str) -> int:
        """The index after the bracket that closes the one at j."""
        depth = 0
        while j < len(self.toks):
            depth += self.toks[j].text == opening
            depth -= self.toks[j].text == close
            j += 1
            if not depth:
                break
        return j

    def modifiers(self) -> Node | None:
        start, kids = self.begin(), []
        stop = self._past_modifiers(self.i)
        while self.i < stop:
            if self.at("@"):
                kids.append(self.annotation())
            else:
                kids.append(self.leaf(self.text))
        return self.make("modifiers", start, kids) if kids else None

    def annotation(self) -> Node:
        start = self.begin()
        self.skip("@")
        name = self.scoped("identifier", "scoped_identifier")
        args = None
        if self.at("("):
            begin = self.begin()
            self.i += 1
            args = self.make("annotation_argument_list", begin, self.listed(")", self._element))
        return self.make("annotation" if args else "marker_annotation", start, [name, args], name=name, arguments=args)

    def _element(self) -> Node:
        start = self.begin()
        if self.kind == "name" and self.ahead() == "=":
            key = self.leaf("identifier")
            self.i += 1
            value = self._element()
            return self.make("element_value_pair", start, [key, value], key=key, value=value)
        if self.at("@"):
            return self.annotation()
        if self.at("{"):
            self.i += 1
            return self.make("element_value_array_initializer", start, self.listed("}", self._element))
        return self.expression()

    def scoped(self, single: str, several: str) -> Node:
        """A dotted name; names of types nest to the left."""
        n = self.leaf(single) if self.kind == "name" else self.leaf()
        while self.at(".") and self.ahead_kind() == "name":
            self.i += 1
            last = self.leaf(single)
            n = self.make(several, n.start, [n, last], scope=n, name=last)
        return n

    def declaration(self, owner: str | None) -> Node:
        start = self.begin()
        if self.at("package"):
            self.i += 1
            kids = [self.scoped("identifier", "scoped_identifier")]
            self.skip(";")
            return self.make("package_declaration", start, kids)
        if self.at("import"):
            self.i += 1
            self.skip("static")
            name = self.scoped("identifier", "scoped_identifier") if self.kind == "name" else None
            star = None
            if self.at(".") and self.ahead() == "*":
                self.i += 1
                star = self.leaf("asterisk")
            self.skip(";")
            return self.make("import_declaration", start, [name, star], name=name, asterisk=star)
        mods = self.modifiers()
        if self.at("class", "interface", "enum", "record") and self.ahead_kind() == "name" or self.at("@"):
            return self.type_declaration(start, mods)
        return self.member(start, mods, owner)

    def type_declaration(self, start: int, mods: Node | None) -> Node:
        self.skip("@")
        word = self.leaf().text
        name = self.leaf("identifier") if self.kind == "name" else None
        kids, fields = [mods, name], {"name": name}
        if self.at("<"):
            kids.append(self.type_parameters())
        if word == "record" and self.at("("):
            kids.append(self.parameters())
        while self.at("extends", "implements", "permits"):
            begin, clause = self.begin(), self.leaf().text
            types = [self.type_()]
            while self.skip(","):
                types.append(self.type_())
            kind = "superclass" if clause == "extends" and word == "class" else {"implements": "super_interfaces", "permits": "permits"}.get(clause, "extends_interfaces")
            n = self.make(kind, begin, types)
            kids.append(n)
            fields[kind] = n
        body = self.body(name.text if name else None, word)
        kids.append(body)
        return self.make({"class": "class_declaration", "interface": "interface_declaration", "enum": "enum_declaration", "record": "record_declaration"}.get(word, "annotation_type_declaration"), start, kids, **fields, body=body)

    def body(self, owner: str | None, word: str = "class") -> Node:
        start, kids = self.begin(), []
        kind = {"class": "class_body", "interface": "interface_body", "enum": "enum_body", "record": "class_body"}.get(word, "annotation_type_body")
        if not self.skip("{"):
            return Node(kind, start, start, self.source)
        self.depth += 1
        if word == "enum":
            while self.tok and not self.at(";", "}"):
                before, begin = self.i, self.begin()
                if self.skip(","):
                    continue
                marks = self.modifiers()
                if self.kind == "name":
                    label = self.leaf("identifier")
                    args = self.arguments() if self.at("(") else None
                    inner = self.body(owner) if self.at("{") else None
                    kids.append(self.make("enum_constant", begin, [marks, label, args, inner], name=label))
                if self.i == before:
                    kids.append(self.leaf())
        while self.tok and not self.at("}"):
            before = self.i
            if self.skip(";"):
                continue
            if self.depth > MAX_DEPTH:
                kids.append(self.leaf())
                continue
            kids.append(self.declaration(owner))
            if self.i == before:
                kids.append(self.leaf())
        self.depth -= 1
        self.skip("}")
        return self.make(kind, start, kids)

    def type_parameters(self) -> Node:
        start, kids, depth = self.begin(), [], 0
        while self.tok:
            depth += self.at("<")
            depth -= self.at(">")
            if self.kind == "name":
                kids.append(self.leaf("type_identifier" if self.text not in ("extends", "super") else self.text))
            elif self.at("{", ";"):
                break
            else:
                self.i += 1
            if depth <= 0:
                break
        return self.make("type_parameters", start, kids)

    def type_(self) -> Node:
        start = self.begin()
        while self.at("@"):
            self.annotation()
        if self.at("?"):
            self.i += 1
            kids = [self.type_()] if self.skip("extends", "super") else []
            return self.make("wildcard", start, kids)
        if self.kind == "name" and self.text in _PRIMITIVE:
            n = self.leaf(_PRIMITIVE[self.text])
        elif self.kind == "name":
            n = self.scoped("type_identifier", "scoped_type_identifier")
        else:
            return self.leaf() if self.tok else Node("ERROR", start, start, self.source)
        if self.at("<"):
            n = self.make("generic_type", start, [n, self.type_arguments()])
            while self.at(".") and self.ahead_kind() == "name":
                self.i += 1
                n = self.make("scoped_type_identifier", start, [n, self.leaf("type_identifier")])
        while self.at("[") and self.ahead() == "]":
            self.i += 2
            n = self.make("array_type", start, [n])
        if self.at("..."):
            self.i += 1
        return n

    def type_arguments(self) -> Node:
        start = self.begin()
        self.skip("<")
        self.depth += 1
        kids = []
        while self.tok and not self.at(">", ";", "{", "}", "(", ")"):
            before = self.i
            if self.skip(",", "&"):
                continue
            kids.append(self.type_() if self.depth < MAX_DEPTH else self.leaf())
            if self.i == before:
                kids.append(self.leaf())
        self.depth -= 1
        self.skip(">")
        return self.make("type_arguments", start, kids)

    def parameters(self) -> Node:
        start = self.begin()
        self.skip("(")

        def one() -> Node:
            b = self.begin()
            mods = self.modifiers()
            t = self.type_()
            name = self.leaf("identifier") if self.kind == "name" else None
            while self.at("[", "]"):
                self.i += 1
            return self.make("formal_parameter", b, [mods, t, name], type=t, name=name)

        return self.make("formal_parameters", start, self.listed(")", one))

    def member(self, start: int, mods: Node | None, owner: str | None) -> Node:
        if self.at("{"):
            return self.make("static_initializer" if mods else "block", start, [mods, self.block()])
        types = self.type_parameters() if self.at("<") else None
        if self.kind == "name" and self.ahead() in ("(", "{") and (self.ahead() == "(" or self.text == owner):
            # No type before the name: a constructor.
            name = self.leaf("identifier")
            params = self.parameters() if self.at("(") else None
            throws = self.throws()
            body = self.block("constructor_body")
            return self.make("constructor_declaration", start, [mods, types, name, params, throws, body], name=name, parameters=params, body=body, modifiers=mods)
        t = self.type_()
        if self.kind == "name" and self.ahead() == "(":
            name = self.leaf("identifier")
            params = self.parameters()
            while self.at("[", "]"):
                self.i += 1
            throws = self.throws()
            body = None
            if self.at("{"):
                body = self.block()
            else:
                if self.skip("default"):
                    throws = self._element()
                self.skip(";")
            return self.make("method_declaration", start, [mods, types, t, name, params, throws, body], name=name, type=t, parameters=params, body=body, modifiers=mods)
        found = self.declarators()
        self.skip(";")
        return self.make("field_declaration", start, [mods, t, *found], type=t, declarator=found[0] if found else None, modifiers=mods)

    def throws(self) -> Node | None:
        start = self.begin()
        if not self.skip("throws"):
            return None
        kids = [self.type_()]
        while self.skip(","):
            kids.append(self.type_())
        return self.make("throws", start, kids)

    def declarators(self) -> list[Node]:
        out = []
        while self.kind == "name":
            start = self.begin()
            name = self.leaf("identifier")
            while self.at("[", "]"):
                self.i += 1
            value = None
            if self.skip("="):
                value = self.initialiser()
            out.append(self.make("variable_declarator", start, [name, value], name=name, value=value))
            if not self.skip(","):
                break
        return out

    def initialiser(self) -> Node:
        if not self.at("{"):
            return self.expression()
        start = self.begin()
        self.i += 1
        return self.make("array_initializer", start, self.listed("}", self.initialiser))

    # -- statements -------------------------------------------------------------------
    def block(self, kind: str = "block") -> Node:
        start, kids = self.begin(), []
        if not self.skip("{"):
            return Node(kind, start, start, self.source)
        while self.tok and not self.at("}"):
            before = self.i
            kids.append(self.statement())
            if self.i == before:
                kids.append(self.leaf())
        self.skip("}")
        return self.make(kind, start, kids)

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
        if t == "{":
            return self.block()
        if t == ";":
            return self.leaf(";")
        if self._declares():
            return self.declaration(None)
        if t in ("if", "while", "switch", "synchronized"):
            self.i += 1
            test = self.parenthesised()
            if t == "switch":
                return self.make("switch_expression", start, [test, self.cases()])
            kids = [test, self.statement()]
            fields = {}
            if t == "if":
                fields = {"consequence": kids[1]}
                if self.skip("else"):
                    kids.append(self.statement())
                    fields["alternative"] = kids[-1]
            return self.make(f"{t}_statement", start, kids, **fields)
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
            return self.try_()
        if t in ("return", "throw", "break", "continue", "assert", "yield") and self.ahead() not in (".", "="):
            self.i += 1
            kids = []
            while self.tok and not self.at(";", "}"):
                before = self.i
                if not self.skip(":"):
                    kids.append(self.expression())
                if self.i == before:
                    kids.append(self.leaf())
            self.skip(";")
            return self.make(f"{t}_statement", start, kids)
        if self.kind == "name" and self.ahead() == ":" and t not in _STATEMENTS:
            label = self.leaf("identifier")
            self.i += 1
            return self.make("labeled_statement", start, [label, self.statement()])
        if self._local():
            mods = self.modifiers()
            ty = self.type_()
            found = self.declarators()
            self.skip(";")
            return self.make("local_variable_declaration", start, [mods, ty, *found], type=ty, declarator=found[0] if found else None)
        inner = self.expression()
        self.skip(";")
        return self.make("expression_statement", start, [inner])

    def _type_end(self, j: int) -> int:
        """The index after a type that begins at j, or -1."""
        toks = self.toks
        if j >= len(toks) or toks[j].kind != "name" or toks[j].text in ("new", "return", "throw", "this", "super", "instanceof", "null", "true", "false", *_STATEMENTS):
            return -1
        j += 1
        while True:
            if j + 1 < len(toks) and toks[j].text == "." and toks[j + 1].kind == "name":
                j += 2
            elif j < len(toks) and toks[j].text == "<":
                depth = 0
                while j < len(toks):
                    t = toks[j]
                    if t.text == "<":
                        depth += 1
                    elif t.text == ">":
                        depth -= 1
                    elif t.kind != "name" and t.text not in (",", ".", "?", "&", "[", "]", "@"):
                        return -1
                    j += 1
                    if not depth:
                        break
                if depth:
                    return -1
            elif j + 1 < len(toks) and toks[j].text == "[" and toks[j + 1].text == "]":
                j += 2
            else:
                return j

    def _local(self) -> bool:
        """Whether a local variable is declared here: a type and a name."""
        j = self._past_modifiers(self.i)
        k = self._type_end(j)
        return k > 0 and k < len(self.toks) and self.toks[k].kind == "name" and self.toks[k].text != "instanceof" and (k + 1 >= len(self.toks) or self.toks[k + 1].text in ("=", ";", ",", ":", "[", ")"))

    def for_(self) -> Node:
        start, kids, kind = self.begin(), [], "for_statement"
        self.i += 1
        if self.skip("("):
            while self.tok and not self.at(")"):
                before = self.i
                if self.skip(";", ","):
                    continue
                if self._local():
                    begin = self.begin()
                    mods = self.modifiers()
                    t = self.type_()
                    if self.kind == "name" and self.ahead() == ":":
                        kind = "enhanced_for_statement"
                        kids += [mods, t, self.leaf("identifier")]
                        self.i += 1
                        kids.append(self.expression())
                    else:
                        found = self.declarators()
                        kids.append(self.make("local_variable_declaration", begin, [mods, t, *found], type=t, declarator=found[0] if found else None))
                else:
                    kids.append(self.expression())
                if self.i == before:
                    kids.append(self.leaf())
            self.skip(")")
        kids.append(self.statement())
        return self.make(kind, start, kids)

    def try_(self) -> Node:
        start, kids, kind = self.begin(), [], "try_statement"
        self.i += 1
        if self.at("("):
            kind, begin = "try_with_resources_statement", self.begin()
            self.i += 1

            def resource() -> Node:
                b = self.begin()
                if self._local():
                    mods, t = self.modifiers(), self.type_()
                    name = self.leaf("identifier") if self.kind == "name" else None
                    value = self.expression() if self.skip("=") else None
                    return self.make("resource", b, [mods, t, name, value], name=name, value=value)
                return self.make("resource", b, [self.expression()])

            kids.append(self.make("resource_specification", begin, self.listed(")", resource, ";")))
        kids.append(self.block())
        while self.at("catch", "finally"):
            begin, word = self.begin(), self.leaf().text
            param = None
            if word == "catch" and self.skip("("):
                b = self.begin()
                mods = self.modifiers()
                types = [self.type_()]
                while self.skip("|"):
                    types.append(self.type_())
                name = self.leaf("identifier") if self.kind == "name" else None
                param = self.make("catch_formal_parameter", b, [mods, self.make("catch_type", b, types), name], name=name)
                self.skip(")")
            kids.append(self.make(f"{word}_clause", begin, [param, self.block()]))
        return self.make(kind, start, kids)

    def cases(self) -> Node:
        start, kids = self.begin(), []
        self.skip("{")
        while self.tok and not self.at("}"):
            before = self.i
            if self.at("case", "default"):
                begin = self.begin()
                self.i += 1
                labels = []
                while self.tok and not self.at(":", "->", "}"):
                    if self.skip(","):
                        continue
                    labels.append(self.expression() if not self.at("default") else self.leaf())
                kids.append(self.make("switch_label", begin, labels))
                self.skip(":", "->")
            else:
                kids.append(self.statement())
            if self.i == before:
                kids.append(self.leaf())
        self.skip("}")
        return self.make("switch_block", start, kids)

    def parenthesised(self) -> Node:
        start = self.begin()
        if not self.skip("("):
            return Node("ERROR", start, start, self.source)
        kids = [] if self.at(")") else [self.expression()]
        while self.tok and not self.at(")"):
            kids.append(self.leaf())
        self.skip(")")
        return self.make("parenthesized_expression", start, kids)

    # -- expressions ------------------------------------------------------------------
    def operator(self) -> str:
        op = super().operator()
        if op == ">" and self.ahead() == ">":
            return ">>"
        return op

    def take_operator(self, op: str) -> list[Node]:
        if op == ">>":
            start = self.begin()
            while self.at(">", ">="):
                self.i += 1
            return [self.make(">>", start, [])]
        sign = [self.leaf(op)]
        if op == "?":
            middle = self.expression()
            self.skip(":")
            return [middle]
        return sign

    def binary_type(self, op: str) -> str:
        return "assignment_expression" if op in _ASSIGN else "ternary_expression" if op == "?" else "instanceof_expression" if op == "instanceof" else "binary_expression"

    def make(self, kind: str, start: int, kids: list, **fields) -> Node:
        if kind == "ternary_expression":
            fields = {"condition": kids[0], "consequence": kids[1], "alternative": kids[-1]}
        return super().make(kind, start, kids, **fields)

    def expression(self, least: int = 0) -> Node:
        n = super().expression(least)
        if n.type == "instanceof_expression" and self.kind == "name" and not self.at("instanceof"):
            name = self.leaf("identifier")
            n.kids.append(name)
            name.parent, n.end = n, name.end
        return n

    def lambda_(self) -> bool:
        if self.kind == "name":
            return self.ahead() == "->"
        if not self.at("("):
            return False
        j = self._past(self.i, "(", ")")
        return j < len(self.toks) and self.toks[j].text == "->"

    def _cast(self) -> bool:
        """Whether a cast begins at the parenthesis."""
        if self.ahead() in _PRIMITIVE:
            j = self.i + 2
            while j < len(self.toks) and self.toks[j].text in ("[", "]"):
                j += 1
            return j < len(self.toks) and self.toks[j].text == ")"
        j = self._type_end(self.i + 1)
        while 0 < j < len(self.toks) and self.toks[j].text == "&":
            j = self._type_end(j + 1)
        if j < 0 or j + 1 >= len(self.toks) or self.toks[j].text != ")":
            return False
        after = self.toks[j + 1]
        return after.kind in ("name", "string", "number") and after.text != "instanceof" or after.text in ("(", "!", "~")

    def prefix(self) -> Node:
        start, t = self.begin(), self.tok
        if t is None:
            return Node("ERROR", start, start, self.source)
        if self.lambda_():
            if self.at("("):
                begin = self.i
                typed = self.toks[self.i + 2].text not in (",", ")") and self.ahead() != ")" if self.i + 2 < len(self.toks) else False
                if typed:
                    params = self.parameters()
                else:
                    self.i = begin + 1
                    b = self.toks[begin].start
                    params = self.make("inferred_parameters", b, self.listed(")", lambda: self.leaf("identifier") if self.kind == "name" else self.leaf()))
            else:
                params = self.leaf("identifier")
            self.skip("->")
            body = self.block() if self.at("{") else self.expression()
            return self.make("lambda_expression", start, [params, body], parameters=params, body=body)
        if t.kind == "name" and t.text == "new":
            return self.creation()
        if t.kind == "name" and t.text == "switch" and self.ahead() == "(":
            return self._statement()
        if t.kind == "name" and t.text in _PRIMITIVE:
            return self.type_()
        if t.text == "(":
            if self._cast():
                self.i += 1
                ty = self.type_()
                while self.skip("&"):
                    self.type_()
                self.skip(")")
                value = self.expression(13)
                return self.make("cast_expression", start, [ty, value], type=ty, value=value)
            return self.parenthesised()
        if t.text in ("-", "+", "!", "~"):
            self.i += 1
            return self.make("unary_expression", start, [self.expression(13)])
        if t.text in ("++", "--"):
            self.i += 1
            return self.make("update_expression", start, [self.expression(13)])
        if t.text == "{":
            return self.initialiser()
        if t.text == "@":
            return self.annotation()
        if t.kind == "name" and self.ahead() == "(" and t.text not in ("this", "super"):
            name = self.leaf("identifier")
            args = self.arguments()
            return self.make("method_invocation", start, [name, args], name=name, arguments=args)
        if t.kind == "name" and t.text in ("this", "super") and self.ahead() == "(":
            n = self.leaf()
            args = self.arguments()
            return self.make("explicit_constructor_invocation", start, [n, args], arguments=args)
        return self.leaf()

    def creation(self) -> Node:
        start = self.begin()
        self.i += 1
        n = self.leaf(_PRIMITIVE[self.text]) if self.text in _PRIMITIVE else self.scoped("type_identifier", "scoped_type_identifier") if self.kind == "name" else None
        if n is not None and self.at("<"):
            n = self.make("generic_type", n.start, [n, self.type_arguments()])
        if self.at("["):
            kids = [n]
            while self.at("["):
                self.i += 1
                if not self.at("]"):
                    b = self.begin()
                    kids.append(self.make("dimensions_expr", b, [self.expression()]))
                self.skip("]")
            if self.at("{"):
                kids.append(self.initialiser())
            return self.make("array_creation_expression", start, kids)
        args = self.arguments() if self.at("(") else None
        body = self.body(None) if self.at("{") else None
        return self.make("object_creation_expression", start, [n, args, body], type=n, arguments=args)

    def arguments(self) -> Node:
        start = self.begin()
        self.skip("(")
        return self.make("argument_list", start, self.listed(")", self.expression))

    def postfix(self, left: Node) -> Node | None:
        if left.type in ("ERROR", "lambda_expression") or self.kind != "op":
            return None
        if self.at("."):
            if self.ahead() == "new":
                self.i += 1
                made = self.creation()
                return self.make("object_creation_expression", left.start, [left, *made.kids], **made.fields)
            if self.ahead() == "<":
                self.i += 1
                self.type_arguments()
                if self.kind != "name":
                    return None
                self.i -= 1
            if self.ahead_kind() != "name" and self.toks[self.i].text == ".":
                return None
            if self.at("."):
                self.i += 1
            else:
                self.i += 1
            name = self.leaf() if self.text in ("this", "super", "class") else self.leaf("identifier")
            if self.at("("):
                args = self.arguments()
                return self.make("method_invocation", left.start, [left, name, args], object=left, name=name, arguments=args)
            return self.make("field_access", left.start, [left, name], object=left, field=name)
        if self.at("["):
            self.i += 1
            index = self.expression() if not self.at("]") else None
            self.skip("]")
            return self.make("array_access", left.start, [left, index], array=left, index=index)
        if self.at("::"):
            self.i += 1
            name = self.leaf("identifier") if self.kind == "name" else None
            return self.make("method_reference", left.start, [left, name])
        if self.at("++", "--"):
            self.i += 1
            return self.make("update_expression", left.start, [left])
        return None
