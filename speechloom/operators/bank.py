"""The engine's own sentences and lexicons: openings and endings by domain, put together by rule. Any other tables of the same columns can be used."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The domains of records.
DOMAINS = ("everyday", "work", "programming", "university", "messaging", "shopping", "travel", "scheduling", "technical", "notes", "email", "lists")

#: Openings of each domain and the group of endings that fit it.
OPENINGS = {
    "everyday": ("home", ("Please water the garden with {name}", "Put {item} on the kitchen table", "Fetch {items} from {location}", "Walk the dog past {location}", "Let {name} feed the cat", "Mend the {item_s} in the hall")),
    "work": ("office", ("Send {name} the budget draft", "Book a room near {location} for {name}", "Present the {tech} roadmap to the board", "Collect feedback on the {item_s} pilot", "Approve {price} for the {item_p}", "Brief {name} and {name2} about the audit")),
    "programming": ("office", ("Merge the patch for the {tech}", "Restart the {tech_s} on port {port}", "Ask {name} to review the {tech} change", "Pin the library at version {version}", "Log errors of the {tech_p} for {name}", "Raise the test coverage to {percent}")),
    "university": ("office", ("Hand in the essay to {name}", "Revise chapter {number} with {name}", "Borrow {items} for the lab at {location}", "Register for seminar {id}", "Rehearse the talk about the {tech} with {name}", "Return the {item_p} to the institute")),
    "messaging": ("home", ("Tell {name} that we meet at {location}", "Text {name2} the address of {location}", "Answer {name} about the {item}", "Share the photo of the {item_s} with {name}", "Wish {name} luck with the move", "Ask {name} whether {name2} can come")),
    "shopping": ("home", ("Buy {items} for {name}", "Compare the {item_p} at {location}", "Pay {price} for the {item}", "Order the {item_s} with a discount of {percent}", "Exchange the {item} at {location}", "Reserve {number} boxes of {item_p}")),
    "travel": ("home", ("Take the train from {location} to {location}", "Pack {items} for the journey", "Check in with {name} at {location}", "Rent a van near {location}", "Print ticket {id} for {name}", "Keep {price} ready for the toll")),
    "scheduling": ("office", ("Move the review from {time} to {time}", "Invite {name} and {name2} to the retreat", "Block {duration} for the {tech} handover", "Shift the delivery of the {item_p} from {date} to {date}", "Hold the briefing at {location}", "Set an alarm for {name}")),
    "technical": ("office", ("Upgrade the {tech} to version {version}", "Open port {port} for the {tech_s}", "Watch the {tech_p} for {duration}", "Trace request {id} through the {tech}", "Cut the load of the {tech_s} by {percent}", "Hand the runbook of the {tech} to {name}")),
    "notes": ("home", ("Remember the {item} for {name}", "The code of the {item_s} is {id}", "Note that {name} prefers {location}", "Keep {number} spare {item_p} at {location}", "Write down {items}", "The deposit for the {item} was {price}")),
    "email": ("office", ("Forward the invoice of {price} to {name}", "Reply to {name} about ticket {id}", "Attach the list of {item_p} for {name}", "Thank {name} for the visit to {location}", "Confirm the {tech} training with {name}", "Remind {name} of the deadline")),
    "lists": ("home", ("List {items} for {name}", "Sort the {item_p} by price", "Add {items} and {items} to the plan", "Number the steps for the {tech_s} move", "Cross {item} off the list", "Copy the list of {name} to {name2}")),
}
#: Endings: home and office share those of all.
ENDINGS = {
    "home": ("before {date}", "around {time}", "within {duration}", "and keep the receipt over {price}", "once {name2} is back", "after a stop at {location}", "on {date} at {time}", "as we agreed last time"),
    "office": ("before {date}", "around {time}", "within {duration}", "and cite case {id}", "once {name2} has signed off", "during the visit to {location}", "on {date} at {time}", "as the plan requires"),
}
#: Sentences whose repetition or range must survive, with the parts that are checked.
PRESERVED = (
    ("The market is open from {time} to {time}.", ("from {time} to {time}",)),
    ("The road stays closed between {date} and {date}.", ("between {date} and {date}",)),
    ("It is a very, very old {item_s}.", ("very, very old {item_s}",)),
    ("We need {items} and nothing else.", ("{items}",)),
    ("Ring twice, once for {name} and once for {name2}.", ("once for {name} and once for {name2}",)),
    ("The limit stays at {number} for everyone.", ("stays at {number}",)),
    ("Room {id} has code {number}, so keep both.", ("Room {id} has code {number}",)),
    ("Come before {time} or after {time}.", ("before {time} or after {time}",)),
    ("Read the {item_s} manual, then read it again on {date}.", ("then read it again",)),
    ("The ferry goes from {location} to {location} and back.", ("from {location} to {location}",)),
    ("Round and round the {tech} goes until {time}.", ("Round and round",)),
    ("{name} said no, no and no again.", ("no, no and no again",)),
)
#: Clauses that lengthen a sentence, and the domains they may stand in (none: all).
CLAUSES = (
    ("because {name2} asked for it this week", ()), ("so that nothing is left for {date}", ()), ("which should not take more than {duration}", ()), ("unless {name2} has a better idea", ()),
    ("since the {item_s} came late", ("everyday", "shopping", "lists", "notes")), ("in case the {tech_s} fails again", ("programming", "technical", "work")), ("because the {tech_p} were slow all day", ("programming", "technical")),
    ("even if {location} is a long way off", ("everyday", "travel", "shopping", "messaging")), ("before the call at {time} begins", ("work", "scheduling", "email", "university")), ("while the weather near {location} holds", ("travel", "everyday")),
    ("which leaves {price} for the rest", ("shopping", "work", "email", "travel")), ("so {name2} can check case {id} too", ("work", "email", "university", "technical")),
)
OPENERS = ("Right, here is what I need:", "So, about the week:", "Let me go through it:", "A few things from me:", "Well, to sum it up:")
CLOSERS = ("That is all from my side.", "I think we have it all now.", "Nothing else comes to mind.", "So much for today then.", "Call me if it is unclear.")
#: What joins sentences; those with a comma after them are marked.
CONNECTIVES = (
    ("also", False), ("next", True), ("besides", True), ("and then", False), ("later", True), ("meanwhile", True), ("on the way", True), ("as a start", True), ("if possible", True), ("in return", True), ("to be safe", True),
    ("at the end", True), ("and please", False), ("apart from that", True), ("plus", False), ("on another note", True), ("for the record", True), ("as always", True), ("with some luck", True), ("in the same vein", True),
)

GIVEN = (
    "Ada Bruno Chidi Dana Elif Farid Greta Hana Igor Jun Kofi Lena Mateo Nadia Omar Paula Quentin Rosa Samir Tova Ulrich Vera Wanda Xenia Yusuf Zoe Anton Bianca Carlos Doris Emil Fatima Gustav Helena Ines Jonas Katya Leon Mira "
    "Noah Olga Pavel Rania Stefan Tara Umar Viktor Wilma Yara Zeno Amara Boris Celine Darius Esther Felix Gloria Hugo Isabel Joachim Keiko Lucia Marek Nora Oskar Petra Ramon Silvia Tomas Ursula Valeria Walter Yolanda Zofia Akira "
    "Birgit Cornel Delia Enzo Frida Goran Heidi Ivo Jasmin Klaus Livia Milan Nina Orhan Pilar Ruben Selma Tariq Ulla Vito Wenke Ximena Yannick Zelda"
).split()
FAMILY_NAMES = ("Adler", "Brandt", "Costa", "Dubois", "Evans", "Fischer", "Garcia", "Haddad", "Ito", "Jansen", "Kovac", "Lund", "Moreau", "Novak", "Okafor", "Petrov")
_THINGS = ("lamp", "notebook", "umbrella", "charger", "backpack", "ticket", "towel", "kettle", "ladder", "pillow", "basket", "blanket", "candle", "drill", "folder", "helmet", "jacket", "mirror", "radio", "saddle", "tent", "vase")
_LOOKS = ("blue", "wooden", "spare", "small", "heavy")
_PLACES = ("station", "library", "harbour", "museum", "bakery", "market", "airport", "bridge", "stadium", "gallery")
_SIDES = ("old", "north", "central", "upper", "lower", "new")
_SYSTEMS = ("Postgres", "Kafka", "Docker", "Linux", "Spark", "Python", "Redis", "Nginx", "Hadoop")
_PARTS = ("cluster", "replica", "gateway", "image", "job", "index", "driver", "backup", "worker")


def templates() -> list[tuple[str, str, str, list[str]]]:
    """id, domain, text, preserved parts; sentences that must be preserved have the domain ``preservation``."""
    rows = [
        (f"{domain}_{i:02d}_{j:02d}", domain, f"{opening} {ending}.", [])
        for domain, (group, openings) in OPENINGS.items()
        for i, opening in enumerate(openings)
        for j, ending in enumerate(ENDINGS[group])
    ]
    return rows + [(f"preserved_{i:02d}", "preservation", text, list(parts)) for i, (text, parts) in enumerate(PRESERVED)]


def lexicon() -> list[tuple[str, str]]:
    """kind, value."""
    things = [(look, thing) for look in _LOOKS for thing in _THINGS]
    systems = [(system, part) for system in _SYSTEMS for part in _PARTS]
    return (
        [("name", v) for v in GIVEN] + [("surname", v) for v in FAMILY_NAMES] + [("location", f"the {side} {place}") for side in _SIDES for place in _PLACES]
        + [("item_s", f"{a} {b}") for a, b in things] + [("item_p", f"{a} {b}s") for a, b in things] + [("tech_s", f"{a} {b}") for a, b in systems] + [("tech_p", f"{a} {b}{'es' if b.endswith('x') else 's'}") for a, b in systems]
    )


def template_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(templates(), "template_id string, domain string, text string, preserved array<string>")


def lexicon_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(lexicon(), "kind string, value string")
