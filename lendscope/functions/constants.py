"""Labels and cut points a report reader expects to see unchanged."""

# Upper cut point (exclusive) and label, in ascending order.
SIGNIFICANCE = [(0.001, "***"), (0.01, "**"), (0.05, "*")]
NOT_SIGNIFICANT = "ns"

IV_POWER = [(0.02, "Inútil"), (0.10, "Débil"), (0.30, "Medio"), (0.50, "Fuerte")]
IV_SUSPICIOUS = "⚠️ Sospechoso"

PSI_STABLE_BELOW = 0.10
PSI_MONITOR_BELOW = 0.20
PSI_LABELS = ("Estable", "Monitorear", "Drift")
PSI_ALERT = "ALERTA"

RISK_LOW_SHARE = 0.5
RISK_MID_SHARE = 1.0
RISK_LABELS = ("Bajo", "Medio", "Alto")

WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

WOE_EPSILON = 1e-9
PSI_EPSILON = 1e-6
IQR_REACH = 1.5
HIGH_NULL_SHARE = 0.5
THRESHOLD_FLOOR = 0.01
THRESHOLD_CEILING = 0.95
BATCH_LIMIT = 10_000
MONITOR_MIN_ROWS = 200
