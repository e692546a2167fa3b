"""Prompts, chat messages and training rows as array<struct<role, content>> columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlogic.functions import graph as G
from gridlogic.functions import text as X
from gridlogic.operators.hold import held

VIEWS = ("simple", "grid", "panel")

# What each task gets and gives, from which its prompt is put together.
TASKS = {
    "A": ("a description", "the layout as an ASCII grid", ("ascii",)), "B": ("an ASCII layout", "a description", ("description",)),
    "C": ("a description and a question", "the direction", ("answer",)), "D": ("an ASCII layout and a question", "the direction", ("answer",)),
    "E": ("a description and a question", "the layout and the direction", ("ascii", "answer")), "F": ("a description, its ASCII layout and a question", "the direction", ("answer",)),
    "G": ("a description, then a question", "first the layout, then the direction", ("answer",)), "H": ("a description with its layout, then a question", "the direction", ("answer",)),
}

LAYOUT_GIVEN, LAYOUT_DRAWN = "BDFH", "AEGH"

_TURN_1 = "First turn: draw the objects of the text as a grid, with the question in mind."
_OWN = "Second turn: answer the question from that grid."
_TRUE = "Second turn: you get the true grid; answer the question from it and the text."
_TURNS = ('In the first turn give JSON whose field "ascii" holds the views.', 'In the second turn give JSON whose field "answer" holds the direction.')
# What a task's prompt says of its aim, what is given, what is wanted, and what counts where text and grid differ.
SECTIONS = {
    "A": {
        "title": "Draw what is described", "objective": "A text says where some objects are. Draw them as a grid of characters.",
        "input": ("Place objects by what the text says and by nothing else.", "Where the text leaves a place open, add neither objects nor relations to fill it."),
        "output": ("Every relation of the text must hold in each view.",), "ascii": ("Write an object's name as the text writes it.",),
    },
    "B": {
        "title": "Describe what is drawn", "objective": "A grid of characters shows some objects. Say in plain sentences where they are.",
        "input": ("What the grid shows is true.",), "output": ("Write statements, no questions and no list of cells.",),
        "description": ("Leave no object of the grid out, and say where each is as seen from another.", "Be short; say what can be seen and guess nothing.", "One sentence relates two objects and has the form: A is [relation] B."),
    },
    "C": {
        "title": "Answer from a text", "objective": "A text says where some objects are. Answer a question about two of them.",
        "input": ("Work out where the two objects are from the text.",), "output": ("One direction, as a string, is the whole answer.",),
        "direction": ("It is the direction of the object that is asked about, as seen from the other one.",),
    },
    "D": {
        "title": "Answer from a grid", "objective": "A grid of characters shows some objects. Answer a question about two of them.",
        "input": ("What the grid shows is true; the question names the two objects.",), "output": ("Choose one direction of the list.",),
        "direction": ("Read the direction off the grid, even if you would expect another.",),
    },
    "E": {
        "title": "Answer and draw", "objective": "A text says where some objects are. Answer a question about two of them and draw them all.",
        "input": ("Read the whole text first.", "What you draw must agree with the text."),
        "output": ("The JSON holds the answer and the views that are asked for.",), "ascii": ("What you draw must show what you answer.",),
        "direction": ("Compare your answer with your grid before you give both.",),
    },
    "F": {
        "title": "Answer from a text and a grid", "objective": "A text and a grid are about the same objects. Answer a question about two of them.",
        "input": ("Compare the text with the grid; where they differ, the grid is right.",), "output": ("Choose the one direction that both support.",),
        "direction": ("Between a text and a grid that differ, go by the grid.",),
    },
    "G": {
        "title": "Draw, then answer from your drawing", "objective": f"There are two turns.\n- {_TURN_1}\n- {_OWN}", "input": (_TURN_1, _OWN), "output": _TURNS,
        "direction": ("The grid that you drew decides the answer.",),
    },
    "H": {
        "title": "Draw, then answer from a given grid", "objective": f"There are two turns.\n- {_TURN_1}\n- {_TRUE}", "input": (_TURN_1, _TRUE), "output": _TURNS,
        "direction": ("The grid that you are given decides the answer, not the one that you drew.",),
    },
}
 # fmt: skip
FORMATS = {"grid": "<grid using + - | for borders>", "simple": "<tiny freeform sketch>", "panel": "<box-drawing view>"}
DIRECTIONS = "{left, right, above, below, upper-left, upper-right, lower-left, lower-right, same column, same level}"
DIRECTION_RULES = """The ten directions exclude each other.
- left, right: on the same level; above, below: in the same column
- upper-left, upper-right, lower-left, lower-right: off in both ways
- a vertical question alone may have same level, a horizontal one alone same column"""
LAYOUT_RULES = """- The first printed row is the top, the last row the bottom; the first column is the left edge, the last column the right edge.
- Above is a higher row, below a lower row; left is a smaller column, right a larger column."""
DRAWING_RULES = """Rendering and positioning:
- Use the given uppercase letters, all of them and no others; two that overlap are stacked in one cell.
- Expand rows and columns as needed, with uniform cells and consistent borders.
- A relation places the first entity as seen from the second: above and below in the same column, left and right on the same level, a diagonal one cell diagonally, in another row and another column."""


def views(names: list[str]) -> list[str]:
    """Known views in their order, each once."""
    return [v for v in dict.fromkeys(n.strip().lower() for n in names) if v in VIEWS]


def ascii_block(ascii_struct: Column, names: list[str]) -> Column:
    """Views with their names above, a blank line between."""
    return F.concat_ws("\n\n", *(F.concat(F.lit(f"{v}:\n"), F.rtrim(ascii_struct[v])) for v in views(names)))


def output_schema(task: str, ascii_order: str = "answer_first") -> str:
    """The JSON that an answer must be."""
    names = list(TASKS[task][2])
    if ascii_order == "answer_first" and len(names) > 1:
        names.reverse()
    shapes = {"ascii": '"ascii": {"grid": "..."}', "answer": '"answer": "..."', "description": '"description": "..."'}
    return "{" + ", ".join(shapes[n] for n in names) + "}"


def bullets(lines: tuple[str, ...]) -> str:
    return "\n".join(f"- {x}" for x in lines)


def system_prompt(task: str, detailed: bool = True, ascii_order: str = "answer_first", names: list[str] | tuple[str, ...] = ("grid",)) -> str:
    """One text per task, made once on the driver, of the task's sections; the detailed one adds the title, the objective and headings. names: the
    views that a case's layout is given in; an answer's layout is a grid."""
    given, wanted, out = TASKS[task]
    own = SECTIONS[task]
    read, drawn = task in LAYOUT_GIVEN, task in LAYOUT_DRAWN
    parts = [f"You are given {given}. Give {wanted}."]
    if "answer" in out:
        parts.append(f"The possible directions are {DIRECTIONS}; exactly one is correct.")
    if detailed:
        parts.append(f"{own['title']}.\n{own['objective']}")
    if "answer" in out:
        parts.append(DIRECTION_RULES)
    if read or drawn:
        shown = dict.fromkeys([*(views(list(names)) if read else ()), *(["grid"] if drawn else ())])
        parts += [LAYOUT_RULES, "Formats:\n" + bullets(tuple(f"{v}: {FORMATS[v]}" for v in shown))]
    if drawn:
        parts.append(DRAWING_RULES)
    notes = [("ascii", "On drawing"), ("input", "On what you get"), ("output", "On what you give"), ("direction", "On directions"), ("description", "On descriptions")]
    for key, heading in notes:
        if key in own:
            parts.append(f"{heading}:\n{bullets(own[key])}" if detailed else "\n".join(own[key]))
        if key == "ascii" and {"ascii", "answer"} <= set(out):
            parts.append("Find the answer, then draw a grid that shows it." if ascii_order == "answer_first" else "Draw the grid, then find the answer in it.")
    return "\n\n".join([*parts, f"Answer with JSON alone: {output_schema(task, ascii_order)}"])


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def user_text(task: str, names: list[str]) -> Column:
    """A case's input: description, layout and question, as the task has them; of (description, ascii, query_relation)."""
    parts = []
    if task in "ACEFGH":
        parts.append(F.concat(F.lit("Description: "), F.col("description")))
    if task in "BDFH":
        parts.append(F.concat(F.lit("Layout:\n"), ascii_block(F.col("ascii"), names)))
    if task in "CDEFGH":
        parts.append(F.concat(F.lit("Question: "), F.col("query_relation")))
    return F.concat_ws("\n", *parts)


def expected_output(task: str, ascii_order: str = "answer_first") -> Column:
    """The compact JSON that answers a case."""
    parts = {"ascii": F.struct(F.col("ascii.grid").alias("grid")), "answer": F.col("label"), "description": F.col("description")}
    names = list(TASKS[task][2])
    if ascii_order == "answer_first" and len(names) > 1:
        names.reverse()
    return F.to_json(F.struct(*(parts[n].alias(n) for n in names)))


def conversations(cases: DataFrame, shots: DataFrame, task: str, names: list[str], detailed: bool = True) -> DataFrame:
    """(id, messages): system, the examples as turns, the case. shots is a bounded list of examples (its limit is the caller's); it is gathered
    to one array, which the cases share."""
    turns = F.array(message("user", user_text(task, names)), message("assistant", expected_output(task)))
    examples = shots.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("id", turns.alias("t")))), lambda s: s["t"])).alias("examples"))
    system = F.array(message("system", F.lit(system_prompt(task, detailed, names=names))))
    return cases.join(F.broadcast(examples)).select("id", F.concat(system, "examples", F.array(message("user", user_text(task, names)))).alias("messages"))


def two_turns(cases: DataFrame, generated: DataFrame | None = None, names: tuple[str, ...] = ("grid",)) -> DataFrame:
    """(id, messages): the layout is asked for, answered by what was generated (id, grid: task G) or by the truth (task H), then the question."""
    own = cases.join(generated.select("id", "grid"), "id", "left") if generated is not None else cases.withColumn("grid", F.col("ascii.grid"))
    first = F.to_json(F.struct(F.struct("grid").alias("ascii")))
    turns = [message("system", F.lit(system_prompt("H" if generated is None else "G", names=names))), message("user", F.concat(F.lit("Description: "), F.col("description"))), message("assistant", first), message("user", F.concat(F.lit("Question: "), F.col("query_relation")))]
    return own.select("id", F.array(*turns).alias("messages"))


def training_rows(instances: DataFrame, task: str, seed: int = 42, random_format: bool = False) -> DataFrame:
    """(record_id, prompt, completion, num_components, ascii_format) for A (description to layout), B (layout to description); of
    A-RANDOM-FORMAT each row has one of the three styles by hash. Rows without a layout are left out (P1)."""
    number = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "id").cast("binary")), 1, 13), 16, 10).cast("long")
    view = F.element_at(F.array(*map(F.lit, VIEWS)), (F.pmod(number, F.lit(3)) + 1).cast("int")) if random_format else F.lit("grid")
    own = instances.where(F.col("ascii").isNotNull()).withColumn("ascii_format", view)
    art = F.when(F.col("ascii_format") == "simple", F.col("ascii.simple")).when(F.col("ascii_format") == "panel", F.col("ascii.panel")).otherwise(F.col("ascii.grid"))
    prompt, completion = (F.col("description"), art) if task.upper().startswith("A") else (art, F.col("description"))
    return own.select(F.col("id").alias("record_id"), prompt.alias("prompt"), completion.alias("completion"), "num_components", "ascii_format")


def in_range(instances: DataFrame, low: int, high: int) -> DataFrame:
    """By number of components, none counting as 0."""
    return instances.where(F.coalesce("num_components", F.lit(0)).between(low, high))


def training_dataset(instances: DataFrame, kind: str, max_samples: int | None = None, seed: int = 42) -> DataFrame:
    """A, B, A-RANDOM-FORMAT, or MIXED (A+B), half of each by hash, for which max_samples must be given (Q22)."""
    from gridlogic.operators.sampling import mixed_half

    kind = kind.upper()
    if kind in ("MIXED", "A+B"):
        if max_samples is None:
            raise ValueError("a mixed dataset needs max_samples")
        keyed = [training_rows(instances, t, seed).withColumn("__key", F.xxhash64("record_id", F.lit(t))) for t in "AB"]
        return mixed_half(*keyed, max_samples, seed, "__key").drop("__key")
    if kind not in ("A", "B", "A-RANDOM-FORMAT"):
        raise ValueError(f"unknown dataset: {kind}")
    rows = training_rows(instances, kind[0], seed, random_format=kind == "A-RANDOM-FORMAT")
    return rows if max_samples is None else rows.orderBy(F.xxhash64("record_id", F.lit(seed)), "record_id").limit(max_samples)


def backfilled(rows: DataFrame) -> DataFrame:
    """Dataset rows with reasoning_steps made anew from description and query_relation, right after label; '' where either can't be read or no path leads from one
    object to the other. The graph is of the statements as they are, whether or not they can be placed."""
    stated = F.transform(X.parse_whole(F.col("description")), lambda r: F.struct(F.upper(r["obj1"]).alias("obj1"), F.upper(r["obj2"]).alias("obj2"), r["dir"].alias("dir")))
    asked = X.parse_query(F.col("query_relation"))
    own = held(rows, __obj1=F.upper(asked["obj1"]), __obj2=F.upper(asked["obj2"]), __graph=G.edges(stated))
    own = held(own, __path=G.path_between(F.col("__graph"), F.col("__obj2"), F.col("__obj1")))
    steps = F.coalesce(X.reasoning_chain(F.col("__path")), F.lit(""))
    names = [c for c in rows.columns if c != "reasoning_steps"]
    at = names.index("label") + 1
    return own.select(*names[:at], steps.alias("reasoning_steps"), *names[at:])
