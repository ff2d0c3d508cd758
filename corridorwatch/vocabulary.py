"""Names, word lists and texts that results must carry verbatim."""

# --- fixed values: panel columns -------------------------------------------------
RISK = "v4_model_accident_probability"
COMPONENTS = [
    RISK,
    "current_risk_probability",
    "collision_risk_value",
    "v4_main_dynamic_probability",
    "v4_static_collision_probability",
    "v4_main_adaptive_dynamic_weight",
]
TEMPORAL = [
    "risk_lag_5m",
    "risk_lag_10m",
    "risk_lag_20m",
    "risk_lag_30m",
    "risk_mean_past_30m",
    "risk_max_past_30m",
    "risk_std_past_30m",
    "risk_change_5m",
    "risk_change_30m",
    "risk_acceleration",
]
PANEL_NUMERIC = [
    "direction_code",
    "stake",
    "accident_label",
    "accident_level",
    "current_risk_probability",
    "collision_risk_value",
    "v4_main_dynamic_probability",
    "v4_static_collision_probability",
    "v4_main_adaptive_dynamic_weight",
    "v4_model_accident_probability",
]
PANEL_REQUIRED = ["segment_id", "bin5", "road_code", "direction_code", "stake", "v4_model_accident_probability"]
NEIGHBOUR_CELLS = [
    "upstream_risk_100m",
    "upstream_risk_200m",
    "upstream_risk_300m",
    "upstream_risk_400m",
    "upstream_risk_500m",
    "downstream_risk_100m",
    "downstream_risk_200m",
    "downstream_risk_300m",
    "downstream_risk_400m",
    "downstream_risk_500m",
]
SPATIAL_SUMMARY = [
    "upstream_mean_300m",
    "upstream_max_300m",
    "downstream_mean_300m",
    "downstream_max_300m",
    "neighborhood_mean_500m",
    "neighborhood_max_500m",
    "neighborhood_std_500m",
    "high_risk_cells_500m",
    "spatial_gradient_600m",
    "center_neighbor_contrast",
    "spatial_coherence_500m",
]
SPATIAL = NEIGHBOUR_CELLS + SPATIAL_SUMMARY
CONTEXT = [
    "direction_code",
    "stake_scaled",
    "road_is_s5",
    "hour_sin",
    "hour_cos",
    "weekday_sin",
    "weekday_cos",
]
# The 22 inputs of the student model.
STUDENT = [
    RISK,
    "current_risk_probability",
    "collision_risk_value",
    "risk_lag_5m",
    "risk_lag_30m",
    "risk_mean_past_30m",
    "risk_change_5m",
    "risk_change_30m",
    "upstream_mean_300m",
    "upstream_max_300m",
    "downstream_mean_300m",
    "downstream_max_300m",
    "neighborhood_mean_500m",
    "neighborhood_max_500m",
    "neighborhood_std_500m",
    "high_risk_cells_500m",
    "spatial_gradient_600m",
    "center_neighbor_contrast",
    "direction_code",
    "road_is_s5",
    "hour_sin",
    "hour_cos",
]
INVALID_EVENT_IDS = ["", "0", "0.0", "nan", "none", "null"]

# --- fixed values: allowed ranges of the student inputs --------------------------
FEATURE_RANGES = {
    (0.0, 1.0): [
        RISK,
        "current_risk_probability",
        "collision_risk_value",
        "risk_lag_5m",
        "risk_lag_30m",
        "risk_mean_past_30m",
        "upstream_mean_300m",
        "upstream_max_300m",
        "downstream_mean_300m",
        "downstream_max_300m",
        "neighborhood_mean_500m",
        "neighborhood_max_500m",
        "neighborhood_std_500m",
        "direction_code",
        "road_is_s5",
    ],
    (-1.0, 1.0): [
        "risk_change_5m",
        "risk_change_30m",
        "spatial_gradient_600m",
        "center_neighbor_contrast",
        "hour_sin",
        "hour_cos",
    ],
    (0.0, 11.0): ["high_risk_cells_500m"],
}

# --- fixed values: levels and review states --------------------------------------
LEVEL_HIGH, LEVEL_MID, LEVEL_LOW = "高", "中", "低"
STATE_PENDING, STATE_WATCH = "待复核", "观察"
STATE_REVIEW, STATE_KEEP = "进入人工复核", "保留观察"

# --- fixed values: evidence items (key, feature, note) ---------------------------
EVIDENCE_ITEMS = [
    ("当前风险", "current_risk_probability", "决策时刻的第一阶段风险输入"),
    ("30分钟均值", "risk_mean_past_30m", "过去30分钟风险记忆"),
    ("风险变化", "risk_change_30m", "当前相对30分钟前的变化"),
    ("上游300米", "upstream_mean_300m", "同路同方向上游均值"),
    ("下游300米", "downstream_mean_300m", "同路同方向下游均值"),
    ("邻域峰值", "neighborhood_max_500m", "500米邻域最大风险"),
]
FLAG_NO_TEMPORAL = "过去30分钟风险记忆为空"
FLAG_NO_SPATIAL = "500米邻域风险为空"

# --- fixed values: accident types, families and action sets ----------------------
TYPE_COMBINED, TYPE_ROLLOVER, TYPE_FIRE, TYPE_OTHER = "翻车,碰撞", "翻车", "失火", "其他"
LANE_CONFLICT_TYPES = ["碰撞", "追尾", "刮擦"]
RESPONSE_FAMILY = {
    "碰撞": "Lane-conflict",
    "追尾": "Lane-conflict",
    "刮擦": "Lane-conflict",
    "翻车": "Rollover",
    "失火": "Fire",
    "其他": "Other",
}
FAMILY_LABELS = ["Lane-conflict", "Rollover", "Fire", "Other"]
FAMILY_ACTIONS = {
    "Lane-conflict": ["VMS_WARNING", "VERIFY", "QUEUE_TAIL", "LANE_CONTROL"],
    "Rollover": ["VMS_WARNING", "VERIFY", "HEAVY_RESCUE", "LANE_ISOLATION"],
    "Fire": ["VMS_WARNING", "VERIFY", "FIRE_RESPONSE", "TRAFFIC_STOP"],
    "Other": ["VMS_WARNING", "VERIFY"],
}

# --- fixed values: review actions (label -> code) --------------------------------
ACTION_CODES = {
    "发布上游可变情报板预警": "VMS_WARNING",
    "调取视频或派出巡查核验": "VERIFY",
    "准备重型救援与起吊力量": "HEAVY_RESCUE",
    "临时隔离相邻车道": "LANE_ISOLATION",
    "布设低速队尾预警": "LOW_SPEED_WARNING",
    "加强上游排队传播管控": "QUEUE_PROPAGATION",
    "实施车道控制与分流": "LANE_CONTROL",
    "准备消防与危险品隔离": "FIRE_RESPONSE",
    "实施天气自适应限速": "WEATHER_SPEED_CONTROL",
}
CODE_LABELS = {code: label for label, code in ACTION_CODES.items()}
CLEAR_WEATHER = ["Clear", "晴", "未知", ""]
REVIEW_ENGINE = "policy-safety-fallback"
SEVERITY_PENDING = "待人工确认"
REASON_SCORE = "监督分数 %.3f"
REASON_SPEED = "中位速度 %.1f km/h，存在低速冲击波迹象"
REASON_QUEUE = "上下游交通量差 %.0f，需关注排队传播"
REASON_WEATHER = "天气为%s"
REASON_SEPARATOR, REASON_END = "；", "。"

# --- fixed values: management measures -------------------------------------------
BASE_MEASURES = [
    "Activate upstream variable-message warning and publish the affected direction and kilometre range.",
    "Verify the event by CCTV or patrol before escalating the response level.",
]
WEATHER_TOKENS = ["雨", "雾", "雪", "沙"]
WEATHER_MEASURES = [
    "Apply weather-adaptive speed control and increase the recommended following distance.",
    "Strengthen visibility and skid-risk warnings at upstream gantries.",
]
LANE_MEASURES = [
    "Protect the incident tail with an upstream buffer and prevent secondary collisions.",
    "Coordinate lane control and guide traffic to the available lanes before the queue reaches the upstream detector.",
]
ROLLOVER_MEASURES = [
    "Dispatch heavy rescue and lifting capability and inspect cargo leakage.",
    "Temporarily isolate adjacent lanes until vehicle stability and debris are assessed.",
]
FIRE_MEASURES = [
    "Dispatch fire response and establish an ignition and hazardous-material exclusion zone.",
    "Stop traffic upstream when smoke or thermal risk affects visibility or evacuation.",
]
TRAFFIC_MEASURE = (
    "Use ramp or entrance-flow control to prevent additional demand from entering the congested section."
)
QUEUE_MEASURE = (
    "Treat the upstream-downstream imbalance as queue formation and extend the warning area upstream."
)
SPEED_MEASURE = (
    "Deploy low-speed queue warnings because the observed median speed indicates shockwave risk."
)

# --- fixed values: severity gate --------------------------------------------------
SEVERITY_MINOR, SEVERITY_GENERAL, SEVERITY_MAJOR = "轻微事故", "一般事故", "重大事故"
KEY_VEHICLE = "属于"
FLAG_TYPE = "high-consequence accident type"
FLAG_INJURY = "reported serious injury"
FLAG_FATAL = "reported fatality"
FLAG_VEHICLE = "key passenger or hazardous vehicle"
SEVERITY_REASON = (
    "Only 7 of 306 historical events are general/major; automated severity classification is not statistically reliable."
)
BAND_HIGH, BAND_LOW = "potentially_general_or_higher", "minor_or_uncertain"

# --- fixed values: policy library ---------------------------------------------------
POLICY_VERSION = "1.0"
REVIEW_NOTE = "依据冻结政策库和安全门生成；未调用外部模型。"
SCORE_SEMANTICS = "监督分数用于候选复核；校准概率仅作诊断，不直接替代人工处置判断。"
POLICY_PRINCIPLES = [
    "Verify by CCTV or patrol before irreversible control.",
    "Protect the upstream queue tail before optimizing throughput.",
    "Escalate weather, fire, rollover, injury, and hazardous-material scenarios.",
    "Every recommendation includes location, direction, trigger evidence, and review status.",
]
SEVERITY_REVIEW = {
    "轻微事故": "operator confirmation",
    "一般事故": "mandatory supervisor review",
    "重大事故": "mandatory emergency-command review",
}

# --- fixed values: packets ---------------------------------------------------------
MEMORY_SPATIAL = [
    "upstream_mean_300m",
    "upstream_max_300m",
    "downstream_mean_300m",
    "downstream_max_300m",
    "neighborhood_max_500m",
    "high_risk_cells_500m",
    "spatial_gradient_600m",
]
CONFIRM_INSTRUCTION = (
    "Using only the supplied current-and-past evidence, confirm the suspected road event, "
    "infer type and severity, and return targeted management actions."
)
MONITOR_INSTRUCTION = (
    "Use current-and-past risk evidence to decide whether this high-risk candidate should be "
    "escalated or remain under monitoring."
)
CONFIDENCE_POLICY = "Historical ground truth; online output must include calibrated confidence."
EVIDENCE_SOURCES = [
    "traffic-weather-road context",
    "historical event record",
    "upstream-downstream traffic context",
]
MONITOR_MEASURES = [
    "Retain the segment in the next 10-minute watchlist update.",
    "Escalate only if temporal growth and spatial propagation become coherent.",
]
TEACHER_GENERATION = "rule-grounded teacher seed; not an LLM-generated claim"
NEGATIVE_GENERATION = "hard-negative data distillation seed"

# --- fixed values: audit -----------------------------------------------------------
AUDIT_ACTIONS = ["确认", "驳回", "转人工复核", "备注"]
AUDIT_OPERATOR, AUDIT_TARGET, AUDIT_SOURCE = "值班员", "未指定对象", "平台操作"

# --- fixed values: dispatch actions ------------------------------------------------
DISPATCH_LABELS = {
    "warning": "发布上游预警",
    "patrol": "派出巡查核验",
    "emergency": "预备应急资源",
}
ACTION_PENDING = "待确认"
DEFAULT_SCENARIO = "loss_cost_ratio_5000"

# --- fixed values: registry headers (source header -> column) ----------------------
REGISTRY_HEADERS = {
    "序号": "registry_id",
    "事故发生时间": "occurred_at",
    "路线方向": "direction",
    "匹配桩号值(km)": "stake_km",
    "事故类型": "accident_type",
    "事故等级": "severity",
    "事故区域": "area",
    "事故车辆车型": "vehicle_type",
    "两客一危": "key_vehicle",
    "是否免费通行时间": "free_pass",
    "高明天气": "weather",
    "风向": "wind_direction",
    "风力": "wind_force",
    "温度": "temperature",
    "湿度": "humidity",
    "能见度": "visibility",
    "MQI评分": "mqi",
    "PCI评分": "pci",
    "交通量": "traffic",
    "median_speed": "median_speed",
    "traffic_density": "traffic_density",
    "lane_density": "lane_density",
    "upstream_traffic": "upstream_traffic",
    "downstream_traffic": "downstream_traffic",
    "segment_count": "segment_count",
    "重伤（人数）": "serious_injured",
    "死亡（人数）": "deaths",
}
DIRECTION_TEXT = {"上行": 1, "下行": 0}
