"""Constants and schemas of the memory graph. Fixed values, stated as they are."""

NODE_TYPES = ("File", "Task", "Goal", "Decision", "Evidence", "Failure")
DECAY = {"File": 0.03, "Task": 0.03, "Goal": 0.005, "Decision": 0.01, "Evidence": 0.01, "Failure": 0.02}
DECAY_OTHER = 0.02
IMPORTANCE_STEP = 0.1
DEMOTION = 0.2
CONFIRMATION = 0.1
CONFIDENCE_HUMAN, CONFIDENCE_COMMITTED, CONFIDENCE_DEFAULT = 0.95, 0.85, 0.6
CO_EDIT_WEIGHT, CO_EDIT_FILES, SESSION_GAP_SECONDS = 0.6, 10, 30 * 60
BM25_K1, BM25_B = 1.5, 0.75
SEEDS, HOPS, HOP_DECAY = 8, 2, 0.6
DIRECTORY_BOOST, DIRECTORY_MIN_FILES, COMMON_SHARE = 3.0, 4, 0.8
OVERLAP_FLOOR = 0.4
TIERS = {"tiny": 200, "small": 800, "default": 1800, "large": 5000}
SCORE_FLOOR = 0.02
TEXT_LIMIT, HISTORY_LIMIT, FILE_LIMIT = 80, 24, 120
KINDS = {"message": 0, "code_edit": 1, "artifact": 2, "checkpoint": 3}
ANTONYMS = (("use", "avoid"), ("adopt", "reject"), ("enable", "disable"))
AGENT_WEIGHTS = {
    "Cursor": {"File": 1.3, "Task": 1.2, "Decision": 1.0, "Goal": 0.9, "Failure": 1.0, "Evidence": 0.8},
    "GitHub Copilot": {"File": 1.3, "Task": 1.1, "Decision": 1.0, "Goal": 0.9, "Failure": 1.0, "Evidence": 0.8},
    "Claude Code": {"File": 0.9, "Task": 1.0, "Decision": 1.3, "Goal": 1.2, "Failure": 1.2, "Evidence": 1.0},
    "Codex": {"File": 1.0, "Task": 1.1, "Decision": 1.1, "Goal": 1.0, "Failure": 1.1, "Evidence": 0.9},
    "Antigravity": {"File": 1.0, "Task": 1.0, "Decision": 1.1, "Goal": 1.1, "Failure": 1.0, "Evidence": 1.0},
}

EVENT_DDL = (
    "id string, ts timestamp, source string, type string, nodeId string, text string, status string, path string, file string, summary string, "
    "confidence double, goalId string, supersededBy string, otherId string, outcome string, evidenceId string, decisionId string, kind string, branch string, "
    "causedBy array<string>, fixedBy array<string>, selfResolved boolean, `from` string, `to` string, relation string, weight double, compiledFor string"
)
TIMELINE_DDL = (
    "ts timestamp, kind string, role string, source string, content string, file string, path string, action string, summary string, diff string, extras map<string,string>"
)
EDGE_DDL = "`from` string, `to` string, relation string, weight double, valid_from timestamp, valid_to timestamp"
