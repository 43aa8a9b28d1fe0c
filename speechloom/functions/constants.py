"""Word lists and codes that results depend on."""

# --- Fixed values: they must stay as they are for the same results.
FILLERS = (
    "um", "uh", "er", "hmm", "like", "you know", "I mean", "sort of", "kind of",
    "well", "basically", "right", "so", "okay so", "ah", "err", "I think",
    "you know what", "I guess",
)
ARTIFACTS = ("here is ", "here's ", "sure!", "sure, ", "the cleaned", "cleaned version", "i've cleaned", "as requested", "here you go", "i hope this helps")
MARKERS_EASY = ("no wait", "actually", "I mean", "sorry", "wait")
MARKERS_MEDIUM = ("no wait", "actually", "I mean", "sorry", "wait", "make that", "change that to", "rather", "I meant", "not")
MARKERS_HARD = ("no wait", "actually", "I mean", "sorry", "wait", "make that", "change that to", "rather", "I meant", "not", "oh hold on")
RESTARTS = ("I mean", "wait", "sorry", "actually", "let me rephrase that", "what I meant is")
HEDGES = ("I wanted to say that maybe we could", "I was thinking maybe we should", "what I meant to say was", "so the thing is", "you know what", "hmm")
DISTRACTORS = (
    "discuss the budget first", "go over last week's notes", "review the slides again",
    "talk about the old plan", "check the previous version", "walk through the details again",
    "look at the earlier draft", "compare the two options", "revisit the original idea",
    "run through the numbers once more", "go back to the start", "double-check the dates",
)
DISTRACT_MARKERS = ("but actually", "anyway", "so actually", "I mean")
INSTRUCTION = (
    "You are a speech-to-text compiler. Rewrite the spoken transcript into the "
    "text the user intended to type. Remove disfluencies, stutters, repetitions, "
    "abandoned phrases, and incorrect earlier wording. Resolve self-corrections "
    "using the user's final intended wording. Preserve meaningful information, "
    "names, numbers, dates, times, and technical terms. Apply requested "
    "formatting. Output only the final text."
)
CATEGORIES = ("basic", "filler", "repetition", "correction", "reformulation", "formatting", "long", "mixed")
TRANSFORMS = ("filler", "repetition", "self_correction", "reformulation", "formatting")
COMBOS = ("filler+rep", "filler+corr", "rep+corr", "rep+reform", "corr+fmt", "filler+rep+corr", "filler+corr+fmt", "rep+corr+long", "filler+rep+corr+fmt", "multi-corr")
#: Sorted transform types, joined, to the label of their composition.
LABELS = (
    ("filler", "single"), ("repetition", "single"), ("partial_repetition", "single"), ("false_start", "single"), ("phrase_correction", "single"), ("entity_correction", "single"),
    ("restart", "single"), ("clause_restart", "single"), ("hesitation", "single"), ("formatting_command", "single"), ("self_correction", "multi-corr"), ("filler+repetition", "filler+rep"),
    ("filler+self_correction", "filler+corr"), ("repetition+self_correction", "rep+corr"), ("filler+repetition+self_correction", "filler+rep+corr"),
    ("filler+formatting_command+repetition+self_correction", "filler+rep+corr+fmt"), ("formatting_command+repetition+self_correction", "rep+corr+fmt"),
    ("filler+formatting_command+self_correction", "filler+corr+fmt"), ("formatting_command+self_correction", "corr+fmt"), ("filler+formatting_command+repetition", "filler+rep+fmt"),
    ("restart+self_correction", "restart+corr"), ("clause_restart+self_correction", "clause_restart+corr"),
)
