"""They must equal the ones in the data the library reads, so they are listed as they are."""

# Item ids and their short names, in catalogue order.
ITEM_NAMES = {
    "VH134067": "rule",
    "VH266015": "div",
    "VH302907": "geo",
    "VH507804": "4card",
    "VH139380": "pattern",
    "VH304954": "sub",
    "VH525628": "least",
    "VH266510_2017": "slope_2017",
    "VH266510_2019": "slope_2019",
    "VH269384": "8card",
    "VH271613": "age",
}

# Fixed value: the one accession that is split by year.
SPLIT_BY_YEAR = "VH266510"

# Items whose rare labels are oversampled, with the labels drawn instead.
OVERSAMPLED_ITEMS = {
    "VH271613": ["2", "2A", "2B", "3"],
    "VH266510_2017": ["2", "2A", "2B"],
    "VH266510_2019": ["2", "2A", "2B"],
    "VH269384": ["2", "2A", "2B"],
    "VH507804": ["2", "2A", "2B"],
}
LOWEST_LABELS = ["1", "1A", "1B"]

# Code books of the group attributes.
GROUP_TEXT = {
    "srace10": {0: "", 1: "white", 2: "Afric Amer", 3: "Hispanic", 4: "Asian", 5: "Amer Ind", 6: "Native", 7: ">1 race"},
    "dsex": {0: "", 1: "male", 2: "female"},
    "accom2": {0: "", 1: "accommodated", 2: "Not accommodated"},
    "iep": {0: "", 1: "sd", 2: "not sd"},
    "lep": {0: "", 1: "english", 2: "not english"},
}

# Column renames and the columns every training row keeps.
RENAMES = {"accession": "qid", "predict_from": "text"}
BASE_COLUMNS = ["id", "qid", "label", "label1", "text", "fold", "text1", "text2"]

# Pieces of the prompt text.
PROMPT_EXAMPLE = "Examples: "
PROMPT_QUERY = "Score this response: "
PROMPT_SCORE = "Score: "
PROMPT_GROUP = "Group: "
PROMPT_QUESTION = "question: "

# Whole cells that count as missing.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "n/a", "nan", "null",
]

# Completion score codes, score tokens, selection words, detailed to reduced labels.
SCORE_CODES = {"5": "3", "4": "2A", "3": "2B", "2": "1A", "1": "1B"}
SCORE_TOKENS = ["1", "1A", "1B", "2", "2A", "2B", "3"]
SELECTION_WORDS = {"TRUE FALSE": "Selection A", "FALSE TRUE": "Selection B", "FALSE FALSE": "Selection None"}
REDUCED_LABELS = {"3": ["3", "2A"], "2": ["2B"], "1": ["1A", "1B"]}
REGRADE_CODES = {"1A": 1, "1B": 1, "2A": 2, "2B": 2, "3": 3}

# Folds that never enter training next to the chosen validation and test folds.
HELD_OUT_FOLDS = [9, 10]
