"""Fixed values that results depend on.

Everything in this module is a constant of the churn domain: defaults,
benchmarks, thresholds, texts and labels. They are written out plainly so
that a change of any figure is a visible, reviewable edit.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES: benchmarks and risk directions (metric, benchmark, direction)
# ---------------------------------------------------------------------------
BENCHMARKS = [
    ("Tenure (Months)", 9.0, -1),
    ("Cashback Amount (₹)", 12000.0, -1),
    ("Days Since Last Order", 5.0, 1),
    ("Satisfaction Score", 4.0, -1),
    ("Warehouse Distance (km)", 10.0, 1),
]
BENCHMARK_TOTAL_ORDERS = 8
BENCHMARK_MAX_INACTIVITY = 30

# ---------------------------------------------------------------------------
# FIXED VALUES: business constants
# ---------------------------------------------------------------------------
AVG_ORDER_VALUE = 850.0          # rupees per order
CASHBACK_SHARE = 0.1             # table rule: cashback = orders * 850 * 0.1
RECORD_CASHBACK_PER_ORDER = 85.0  # record rule: max(stat, orders * 85)
BAND_LOW_CUT = 0.3
BAND_HIGH_CUT = 0.7
CLASS_CUT = 0.5
BUDGET_SHARE = {"low": 0.05, "medium": 0.15, "high": 0.25}

# ---------------------------------------------------------------------------
# FIXED VALUES: default statistics used when a column has no valid value
# ---------------------------------------------------------------------------
NUMERIC_DEFAULTS = {
    "Tenure": 12.0,
    "OrderCount": 8.0,
    "CashbackAmount": 5000.0,
    "DaySinceLastOrder": 15.0,
    "HourSpendOnApp": 45.0,
    "OrderAmountHikeFromlastYear": 15.0,
    "CouponUsed": 2.0,
    "NumberOfDeviceRegistered": 2.0,
    "SatisfactionScore": 4.0,
    "WarehouseToHome": 15.0,
    "NumberOfAddress": 3.0,
    "CityTier": 2.0,
    "Complain": 0.0,
}
CATEGORICAL_DEFAULTS = {
    "PreferredLoginDevice": "Mobile Phone",
    "PreferredPaymentMode": "Credit Card",
    "PreferedOrderCat": "Laptop & Accessory",
    "Gender": "Male",
    "MaritalStatus": "Single",
    "CustomerSegment": "Active_New",
}

# ---------------------------------------------------------------------------
# FIXED VALUES: model feature list, in model order
# ---------------------------------------------------------------------------
MODEL_FEATURES = [
    "Tenure", "CityTier", "WarehouseToHome", "HourSpendOnApp", "SatisfactionScore",
    "Complain", "OrderAmountHikeFromlastYear", "CouponUsed", "OrderCount",
    "DaySinceLastOrder", "CashbackAmount", "NumberOfDeviceRegistered",
    "NumberOfAddress", "OrderFrequency", "EngagementIntensity", "ValueScore",
    "PreferredLoginDevice_Mobile Phone", "Gender_Male", "MaritalStatus_Married",
    "PreferredPaymentMode_Credit Card", "PreferedOrderCat_Laptop & Accessory",
    "CustomerSegment_Established", "HighRecencyFlag", "LowSatisfactionFlag",
    "ComplaintFlag",
]
CATEGORICAL_COLUMNS = [
    "PreferredLoginDevice", "Gender", "MaritalStatus", "PreferredPaymentMode",
    "PreferedOrderCat", "CustomerSegment",
]
# columns that feature engineering cannot do without
REQUIRED_COLUMNS = [
    "OrderCount", "Tenure", "DaySinceLastOrder", "CashbackAmount",
    "HourSpendOnApp", "SatisfactionScore", "Complain",
]
# id column names looked for, first match wins
ID_CANDIDATES = ["Customer_ID", "CustomerID", "customer_id", "Customer Id", "Customer"]

# FIXED VALUES: example figures of the impact panel
IMPACT_EXAMPLES = {"estimated_clv": 18750.0, "retention_budget": 1250.0, "potential_revenue_loss": 4250.0,
                   "roi_retention": 3.4}

# FIXED VALUES: prediction columns that end a report, in this order
REPORT_LAST = ["Churn_Probability", "Churn_Probability_Percent", "Risk_Level", "Predicted_Churn",
               "Retention_Recommendation"]

# ---------------------------------------------------------------------------
# FIXED VALUES: category synonyms and binary codes (training data cleanup)
# ---------------------------------------------------------------------------
SYNONYMS = {
    "PreferredLoginDevice": {"Phone": "Mobile Phone"},
    "PreferredPaymentMode": {"CC": "Credit Card", "Cash on Delivery": "COD"},
    "PreferedOrderCat": {"Mobile": "Mobile Phone"},
}
BINARY_CODES = {
    "PreferredLoginDevice": {"Mobile Phone": 0, "Computer": 1},
    "Gender": {"Male": 0, "Female": 1},
}

# ---------------------------------------------------------------------------
# FIXED VALUES: scorecard coefficients (hand-picked, not fitted)
#   z = 0.8 - 0.10*Tenure + 0.010*DaySinceLastOrder - 0.06*OrderCount
#       - 0.20*SatisfactionScore + 1.2*Complain ;  p = 1 / (1 + exp(-z))
# ---------------------------------------------------------------------------
SCORECARD_INTERCEPT = 0.8
SCORECARD_WEIGHTS = [
    ("Tenure", -0.10),
    ("DaySinceLastOrder", 0.010),
    ("OrderCount", -0.06),
    ("SatisfactionScore", -0.20),
    ("Complain", 1.2),
]

# ---------------------------------------------------------------------------
# FIXED VALUES: validation rules (message per rule)
# ---------------------------------------------------------------------------
MSG_TENURE_HIGH = "Tenure seems unusually high (max 200 months expected)"
MSG_TENURE_NEG = "Tenure cannot be negative"
MSG_DAYS_HIGH = "Last order over 1 year ago - please verify data"
MSG_DAYS_NEG = "Days since last order cannot be negative"
MSG_CASHBACK_HIGH = "Cashback amount seems unusually high"
MSG_CASHBACK_NEG = "Cashback amount cannot be negative"
MSG_CASHBACK_NO_ORDERS = "Cashback without orders - data inconsistency"
MSG_SATISFACTION_RANGE = "Satisfaction score must be between 1 and 5"

# ---------------------------------------------------------------------------
# FIXED VALUES: band labels
# ---------------------------------------------------------------------------
BAND_BATCH = ("Low Risk", "Moderate Risk", "High Risk")
BAND_REPORT = ("P3: Low Risk (<=30%)", "P2: Moderate Risk (31-70%)", "P1: High Risk (>70%)")
BAND_RECORD = ("low", "medium", "high")

# ---------------------------------------------------------------------------
# FIXED VALUES: recommendation texts
# ---------------------------------------------------------------------------
RECORD_RECOMMENDATIONS = {
    "low": [
        "Loyalty Reinforcement: Enroll in a tiered loyalty program or highlight existing status.",
        "Proactive Value Communication: Use non-sales content (tips/guides) to maintain brand presence.",
        "Advocacy & Growth: Offer incentives for referrals or reviews to generate brand advocacy.",
    ],
    "medium": [
        "Timed Intervention: Deploy a high-value, exclusive discount/bonus offer within 7 days.",
        "Friction Removal: Focus surveys on pain points (payments/app) for immediate system fixes.",
        "Personalization: Send product recommendations based on purchase history to drive repeat visits.",
    ],
    "high": [
        "Critical 1:1 Outreach: Initiate executive-level, high-touch contact (call/VIP chat) within 24 hours.",
        "Premium Incentives: Offer a premium, non-monetary incentive (e.g., free upgrade) to stabilize the customer.",
        "Root Cause Analysis: Immediately analyze past 3 interactions to resolve specific dissatisfaction causes.",
    ],
}
BATCH_RECOMMENDATIONS = {
    "High Risk": "Immediate personalized outreach + Exclusive offers + Executive escalation",
    "Moderate Risk": "Proactive engagement campaigns + Loyalty program enrollment + Personalized recommendations",
    "Low Risk": "Regular communication + Upselling opportunities + Referral program promotion",
}

# ---------------------------------------------------------------------------
# FIXED VALUES: primary risk factor tests, in order (label, severity)
# ---------------------------------------------------------------------------
FACTOR_SHORT_TENURE = "Short Customer Tenure"
FACTOR_MEDIUM_TENURE = "Medium Customer Tenure"
FACTOR_LONG_INACTIVITY = "Long Inactivity Period"
FACTOR_RECENT_INACTIVITY = "Recent Inactivity"
FACTOR_LOW_SATISFACTION = "Low Satisfaction Score"
FACTOR_AVG_SATISFACTION = "Average Satisfaction Score"
FACTOR_COMPLAINTS = "Previous Complaints"
FACTOR_LOW_ORDERS = "Low Order Frequency"
FACTOR_LOW_REWARD = "Low Reward Engagement"
FACTOR_FALLBACK_HIGH = "Multiple Risk Factors Combined"
FACTOR_FALLBACK_MEDIUM = "Moderate Behavioral Patterns"
FACTOR_FALLBACK_LOW = "Standard Customer Profile"
TOP_DRIVER_DEFAULT = "general behavior"

# driver name (lower-case) -> display label
DRIVER_LABELS = {
    "tenure": "Short Customer Tenure",
    "daysincelastorder": "Recent Inactivity",
    "satisfactionscore": "Low Satisfaction Level",
    "complain": "Previous Customer Complaints",
    "cashbackamount": "Low Reward Program Engagement",
    "ordercount": "Infrequent Purchases",
    "warehousetohome": "Long Delivery Distance",
    "hourspendonapp": "Low App Engagement",
    "preferredlogindevice": "Device Usage Pattern",
    "citytier": "Geographic Location Factor",
}

# ---------------------------------------------------------------------------
# FIXED VALUES: KPI targets (metric, target text, threshold)
# ---------------------------------------------------------------------------
KPI_CHURN_TARGET = 0.15
KPI_TENURE_TARGET = 12.0
KPI_DAYS_TARGET = 7.0
KPI_DAYS_SCALE = 30.0  # full width of the progress bars
KPI_SATISFACTION_SCALE = 5.0
KPI_SATISFACTION_TARGET = 4.0

# executive wording per record band: (category, level, advice)
EXEC_WORDING = {
    "high": ("critical", "high immediate risk", "immediate intervention required"),
    "medium": ("monitoring", "moderate risk", "proactive monitoring recommended"),
    "low": ("stable", "low immediate risk", "proceeding directly to the action plan below"),
}

# ---------------------------------------------------------------------------
# FIXED VALUES: dashboard domains
# ---------------------------------------------------------------------------
TENURE_BUCKETS = ["0-3", "3-6", "6-9", "9-12", "12+"]
CITY_TIERS = ["Tier 1", "Tier 2", "Tier 3"]
MARITAL_DOMAIN = ["Single", "Married", "Divorced"]
GENDER_DOMAIN = ["Male", "Female"]
SATISFACTION_DOMAIN = ["1", "2", "3", "4", "5"]
COMPLAIN_DOMAIN = ["No Complaints", "Complaints"]
CHURN_STATUS_DOMAIN = ["Churned", "Retained"]
PAGE_SIZES = [20, 50, 100, 200]

# ---------------------------------------------------------------------------
# FIXED VALUES: report metadata rows
# ---------------------------------------------------------------------------
METADATA_MODEL = "Ensemble ML Model"
METADATA_STRATEGY = "Median with ML Prediction"
METADATA_NAN = "Yes - Using Smart Imputation"
SUMMARY_METRICS = [
    "Total Customers Analyzed",
    "Average Churn Probability",
    "Overall Churn Rate",
    "High-Risk Customers",
    "Moderate-Risk Customers",
    "Low-Risk Customers",
    "Potential Revenue Loss",
    "Analysis Date",
]

# number of importances considered and kept by the contribution operator
CONTRIBUTION_CANDIDATES = 30
CONTRIBUTION_TOP_N = 10

# FIXED VALUES: lines of the per-customer text report ({..}: what Spark fills in)
TEXT_REPORT = [
    "CUSTOMER CHURN RISK ANALYSIS REPORT",
    "===================================",
    "Generated: {generated}",
    "",
    "EXECUTIVE SUMMARY",
    "-----------------",
    "• Churn Probability: {percent}%",
    "• Risk Level: {band}",
    "• Potential Revenue Loss (Estimated): {loss}",
    "• Primary Risk Factor: {factor}",
    "",
    "RETENTION RECOMMENDATIONS",
    "-------------------------",
    "PRIORITY: {band}",
    "1. {reco1}",
    "2. {reco2}",
    "3. {reco3}",
    "",
    "BUSINESS IMPACT ANALYSIS",
    "------------------------",
    "• Estimated Customer Value: {clv}",
    "• Recommended Retention Budget: {budget}",
    "• ROI Potential: {roi}",
    "",
    "--- END OF REPORT",
]
