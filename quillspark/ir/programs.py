"""Seeded programs with known leakage: four library stacks by six defects."""

from __future__ import annotations

STACKS = {
    "linear": ("from sklearn.linear_model import LogisticRegression", "LogisticRegression()", "from sklearn.preprocessing import StandardScaler", "StandardScaler()"),
    "boosted": ("from xgboost import XGBClassifier", "XGBClassifier(n_estimators=50)", "from sklearn.preprocessing import MinMaxScaler", "MinMaxScaler()"),
    "light": ("from lightgbm import LGBMClassifier", "LGBMClassifier()", "from sklearn.impute import SimpleImputer", "SimpleImputer(strategy='mean')"),
    "forest": ("from sklearn.ensemble import RandomForestRegressor", "RandomForestRegressor(max_depth=4)", "from sklearn.decomposition import PCA", "PCA(n_components=3)"),
}
DEFECTS = ["clean", "preprocessing_before_split", "test_in_train", "metric_on_train", "target_leakage", "no_holdout_evaluation"]


def program(stack: str, defect: str) -> str:
    get_model, model, get_step, step = STACKS[stack]
    lines = ["import pandas as pd", "from sklearn.model_selection import train_test_split", "from sklearn.metrics import accuracy_score", get_model, get_step, "frame = pd.read_csv('observations.csv')", "label = frame['outcome']", "cols = frame.drop('outcome', axis=1)"]
    feats = "cols"
    if defect == "target_leakage":
        lines += ["smoothed = label.rolling(7)", "cols_plus = pd.concat([cols, smoothed])"]
        feats = "cols_plus"
    if defect == "preprocessing_before_split":
        lines += [f"prep = {step}", f"scaled = prep.fit_transform({feats})"]
        feats = "scaled"
    if defect == "no_holdout_evaluation":
        return "\n".join([*lines, f"learner = {model}", f"learner.fit({feats}, label)", f"guess = learner.predict({feats})"])
    lines += [f"a_train, a_test, b_train, b_test = train_test_split({feats}, label, random_state=1)", f"learner = {model}"]
    train, test = "a_train", "a_test"
    if defect != "preprocessing_before_split":
        lines += [f"prep = {step}", "p_train = prep.fit_transform(a_train)", "p_test = prep.transform(a_test)"]
        train, test = "p_train", "p_test"
    lines.append(f"learner.fit({test}, b_test)" if defect == "test_in_train" else f"learner.fit({train}, b_train)")
    if defect == "metric_on_train":
        return "\n".join([*lines, f"fitted = accuracy_score(b_train, {train})"])
    return "\n".join([*lines, f"guess = learner.predict({test})", "quality = accuracy_score(b_test, guess)"])


def corpus(repeats: int = 1) -> list[tuple[str, str, int, str, str]]:
    """(nb_id, cell_id, document_index, source, defect), one cell a notebook."""
    return [(f"{s}-{d}-{i}", f"{i:04d}{k:04d}", 0, program(s, d), d) for i in range(repeats) for k, (s, d) in enumerate((s, d) for s in STACKS for d in DEFECTS)]
