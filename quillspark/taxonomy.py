"""Enumerations of the data model."""

#: Structural node types, edge types, domain node types, operation classes.
NODE = {"VARIABLE": 0, "IMPORT": 1, "DATASET": 2, "FUNCTION": 3, "INTERMEDIATE": 4, "IF": 5, "LOOP": 6, "CLASS": 7, "LITERAL": 8, "CALL": 9}
EDGE = {"CALLER": 0, "INPUT": 1, "OMITTED": 2, "BRANCH": 3, "LOOP": 4, "FUNCTION_CALL": 5, "CLASS_CALL": 6}
DOMAIN_NODE = {
    "VARIABLE": 0, "LIBRARY": 1, "DATASET": 2, "UDF": 3, "MODEL": 4, "COLUMN": 5, "HYPERPARAMETER": 6, "LITERAL": 7,
    "NOT_RELEVANT": 8, "FEATURE_ENGINEERING": 9, "EVALUATION": 10, "ARTIFACT": 11, "LEAKAGE_DETECTED": 12, "DEAD_CODE": 13,
}
OPERATION = {
    "UNLABELED": -1, "MODEL_OPERATION": 0, "DATA_IMPORT_EXTRACTION": 1, "DATA_TRANSFORM": 2, "EDA": 3, "DATA_EXPORT": 4,
    "NOT_RELEVANT": 5, "ARTIFACT_EXPORT": 6, "LEAKAGE_DETECTED": 12, "DEAD_CODE": 13,
}
HUBS = (3, 6, 9)
COMPUTE_HUBS = (9,)

#: The names that rules and detectors look for.
LOAD_CALLS = "read_csv read_excel read_sql read_sql_query read_json read_table read_parquet read_html read_pickle read_fwf read_stata read_feather read_hdf load loadtxt load_data load_iris load_boston load_digits load_wine load_breast_cancer load_diabetes load_dataset load_files fetch_openml fetch_california_housing fetch_20newsgroups imread open".split()
MODEL_CALLS = "fit predict predict_proba predict_log_proba fit_predict partial_fit score decision_function".split()
MODEL_SUFFIXES = "Classifier Regressor Regression".split()
WRITE_CALLS = "to_csv to_excel to_parquet to_pickle to_json to_sql to_hdf to_feather to_stata to_html savefig savez savetxt save save_weights save_model dump write writerow writerows writelines".split()
TEST_WORDS, TEST_WORDS_WIDE, TRAIN_WORDS = "test val valid validation holdout".split(), "test val valid validation holdout eval".split(), "train training fit".split()
SPLIT_CALLS = ["train_test_split"]
SPLITTER_SUFFIXES, SPLITTERS = "KFold ShuffleSplit LeaveOneOut LeavePOut".split(), "TimeSeriesSplit PredefinedSplit".split()
TRAIN_CALLS = "fit fit_predict partial_fit fit_resample".split()
TRANSFORMER_SUFFIXES = "Scaler Encoder Imputer Normalizer Binarizer Transformer Vectorizer Discretizer Selector".split()
TRANSFORMERS = "PCA TruncatedSVD SelectKBest SelectPercentile PolynomialFeatures SMOTE ADASYN RandomOverSampler RandomUnderSampler TfidfVectorizer CountVectorizer LabelEncoder OneHotEncoder OrdinalEncoder StandardScaler MinMaxScaler RobustScaler MaxAbsScaler QuantileTransformer PowerTransformer KBinsDiscretizer Normalizer SimpleImputer KNNImputer IterativeImputer VarianceThreshold".split()
ESTIMATOR_SUFFIXES = "Classifier Regressor Regression SVC SVR".split()
ESTIMATORS = "LinearRegression LogisticRegression KMeans KNeighborsClassifier KNeighborsRegressor GaussianNB MultinomialNB XGBClassifier XGBRegressor LGBMClassifier LGBMRegressor CatBoostClassifier MLPClassifier MLPRegressor".split()
METRIC_CALLS = "score accuracy_score f1_score precision_score recall_score roc_auc_score average_precision_score log_loss mean_squared_error mean_absolute_error r2_score confusion_matrix classification_report balanced_accuracy_score matthews_corrcoef cohen_kappa_score".split()
#: Library families by word.
FAMILIES = {
    "data_io": "pandas pd numpy np csv json sql sqlite sqlalchemy requests urllib h5py scipy openpyxl pyarrow arrow mdanalysis nglview datasets boto3 glob polars pl pyspark spark dask dd modin cudf vaex koalas ks beam apache_beam duckdb ibis datatable fireducks".split(),
    "ml_classic": "sklearn xgboost xgb lightgbm lgb catboost statsmodels mltools linear svm ensemble".split(),
    "deep_learning": "torch tensorflow tf keras transformers jax fastai lightning".split(),
    "viz": "matplotlib pyplot plt seaborn sns plotly bokeh altair".split(),
    "persistence": "pickle joblib dill".split(),
    "sys_env": "os sys logging warnings gc argparse subprocess shutil".split(),
}
DATA_PATH = r"(?i)\.(?:csv|tsv|parquet|parq|json|jsonl|ndjson|feather|orc|xls[xmb]?|h5|hdf5|pkl|pickle|npy|npz|txt|dat|avro|arrow|db|sqlite3?|gz|zip)\b|(?:https?|s3|gs|gcs|hdfs|file|abfss?|wasbs?|dbfs)://|/[\w.\-]+\.\w+"


def taxonomy(spark):
    """The enumerations as a table (kind, name, code)."""
    rows = [(k, n, c) for k, d in (("node", NODE), ("edge", EDGE), ("domain_node", DOMAIN_NODE), ("operation", OPERATION)) for n, c in d.items()]
    return spark.createDataFrame(rows, "kind string, name string, code int")
