"""Rewrites of small languages in Python syntax to plain calls, where their library is imported."""

from __future__ import annotations

import ast

#: Libraries whose operators are rewritten.
LABELLED, TASKS, PIPES = {"apache_beam", "beam"}, {"airflow"}, {"pipe", "dfply", "siuba", "toolz", "sspipe"}


def roots(tree: ast.AST) -> set[str]:
    """Root libraries that a tree imports."""
    out = set()
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            out |= {a.name.split(".")[0] for a in n.names}
        elif isinstance(n, ast.ImportFrom) and n.module:
            out.add(n.module.split(".")[0])
    return out


class _Labelled(ast.NodeTransformer):
    """`a | 'L' >> T()` is a.T(); `with P() as p` is p = P() and the body."""

    def visit_BinOp(self, node: ast.BinOp) -> ast.AST:
        self.generic_visit(node)
        step = node.right
        if isinstance(step, ast.BinOp) and isinstance(step.op, ast.RShift):
            step = step.right
        if isinstance(node.op, ast.BitOr) and isinstance(step, ast.Call):
            f = step.func
            name = f.attr if isinstance(f, ast.Attribute) else f.id if isinstance(f, ast.Name) else None
            if name:
                func = ast.copy_location(ast.Attribute(node.left, name, ast.Load()), node)
                return ast.copy_location(ast.Call(func, step.args, step.keywords), node)
        return node

    def visit_With(self, node: ast.With) -> ast.AST | list[ast.AST]:
        self.generic_visit(node)
        item = node.items[0]
        if len(node.items) == 1 and isinstance(item.optional_vars, ast.Name) and isinstance(item.context_expr, ast.Call):
            return [ast.copy_location(ast.Assign([item.optional_vars], item.context_expr), node), *node.body]
        return node


class _Tasks(ast.NodeTransformer):
    """`a >> [b, c]` is b = a.set_downstream(b), c = a.set_downstream(c); `<<` the other way round.

    A chain with an operand that is not a name or a list of names stays as it is.
    """

    @staticmethod
    def operand(e: ast.AST) -> bool:
        if isinstance(e, ast.BinOp):
            return isinstance(e.op, (ast.RShift, ast.LShift)) and _Tasks.operand(e.left) and _Tasks.operand(e.right)
        names = e.elts if isinstance(e, ast.List) else [e]
        return bool(names) and all(isinstance(n, ast.Name) for n in names)

    def visit_Expr(self, node: ast.Expr) -> ast.AST | list[ast.AST]:
        made: list[ast.AST] = []
        if not (isinstance(node.value, ast.BinOp) and self.operand(node.value)):
            return node

        def ends(e: ast.AST) -> list[ast.AST]:
            if isinstance(e, ast.BinOp) and isinstance(e.op, (ast.RShift, ast.LShift)):
                left, right = ends(e.left), ends(e.right)
                for a in left:
                    for b in right:
                        up, down = (a, b) if isinstance(e.op, ast.RShift) else (b, a)
                        call = ast.Call(ast.Attribute(ast.Name(up.id, ast.Load()), "set_downstream", ast.Load()), [ast.Name(down.id, ast.Load())], [])
                        made.append(ast.Assign([ast.Name(down.id, ast.Store())], call))
                return right
            return list(e.elts) if isinstance(e, ast.List) else [e]

        ends(node.value)
        return [ast.fix_missing_locations(ast.copy_location(m, node)) for m in made] or node


class _Pipes(ast.NodeTransformer):
    """`x | f(a)` and `x >> f(a)` are x.f(a)."""

    def visit_BinOp(self, node: ast.BinOp) -> ast.AST:
        self.generic_visit(node)
        if isinstance(node.op, (ast.BitOr, ast.RShift)) and isinstance(node.right, ast.Call) and isinstance(node.right.func, ast.Name):
            func = ast.copy_location(ast.Attribute(node.left, node.right.func.id, ast.Load()), node)
            return ast.copy_location(ast.Call(func, node.right.args, node.right.keywords), node)
        return node


PLUGINS = [(LABELLED, _Labelled), (TASKS, _Tasks), (PIPES, _Pipes)]


def rewritten(tree: ast.Module, modules: dict[str, str], imports: bool = True) -> ast.Module:
    """The tree with the operators of libraries among modules, or, where it may have imports, of those that it imports, as calls."""
    known = (roots(tree) if imports else set()) | {m.split(".")[0] for m in modules.values()}
    for names, plugin in PLUGINS:
        if names & known:
            tree = ast.fix_missing_locations(plugin().visit(tree))
    return tree
