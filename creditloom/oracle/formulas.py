"""Column formulas of the feature sets in plain SQL.

One ``NAME = formula`` per line, grouped by the rows a formula ranges over.
They are written out in full, apart from the rules the plans are built from,
so that a wrong rule shows up as a mismatch.
"""

APP = """
APP_CREDIT_TO_INCOME_RATIO = AMT_CREDIT / nullif(AMT_INCOME_TOTAL + 1, 0)
APP_ANNUITY_TO_INCOME_RATIO = AMT_ANNUITY / nullif(AMT_INCOME_TOTAL + 1, 0)
APP_CREDIT_TO_GOODS_RATIO = AMT_CREDIT / nullif(coalesce(AMT_GOODS_PRICE, 1) + 1, 0)
APP_ANNUITY_TO_CREDIT_RATIO = AMT_ANNUITY / nullif(AMT_CREDIT + 1, 0)
APP_GOODS_TO_INCOME_RATIO = AMT_GOODS_PRICE / nullif(AMT_INCOME_TOTAL + 1, 0)
APP_INCOME_AFTER_ANNUITY = AMT_INCOME_TOTAL - coalesce(AMT_ANNUITY, 0)
APP_INCOME_PER_FAMILY_MEMBER = AMT_INCOME_TOTAL / greatest(coalesce(CNT_FAM_MEMBERS, 1), 1)
APP_CREDIT_PER_FAMILY_MEMBER = AMT_CREDIT / greatest(coalesce(CNT_FAM_MEMBERS, 1), 1)
APP_CHILDREN_RATIO = CNT_CHILDREN / greatest(coalesce(CNT_FAM_MEMBERS, 1), 1)
APP_AGE_YEARS = DAYS_BIRTH / -365.25
APP_EMPLOYMENT_YEARS = DAYS_EMPLOYED / -365.25
APP_EMPLOYMENT_TO_AGE_RATIO = DAYS_EMPLOYED / nullif(DAYS_BIRTH, 0)
APP_DAYS_EMPLOYED_ANOMALY = cast(DAYS_EMPLOYED = 365243 as int)
APP_EXT_SOURCE_MEAN = (coalesce(EXT_SOURCE_1, 0) + coalesce(EXT_SOURCE_2, 0) + coalesce(EXT_SOURCE_3, 0)) / 3
APP_EXT_SOURCE_PRODUCT = coalesce(EXT_SOURCE_1, 0) * coalesce(EXT_SOURCE_2, 0) * coalesce(EXT_SOURCE_3, 0)
APP_EXT_SOURCE_1_MISSING = cast(EXT_SOURCE_1 IS NULL as int)
APP_EXT_SOURCE_2_MISSING = cast(EXT_SOURCE_2 IS NULL as int)
APP_EXT_SOURCE_3_MISSING = cast(EXT_SOURCE_3 IS NULL as int)
APP_EXT_SOURCE_2x3 = coalesce(EXT_SOURCE_2, 0) * coalesce(EXT_SOURCE_3, 0)
APP_EXT_SOURCE_1x2 = coalesce(EXT_SOURCE_1, 0) * coalesce(EXT_SOURCE_2, 0)
APP_EXT_SOURCE_1x3 = coalesce(EXT_SOURCE_1, 0) * coalesce(EXT_SOURCE_3, 0)
APP_EXT_SOURCE_2_MINUS_3 = coalesce(EXT_SOURCE_2, 0) - coalesce(EXT_SOURCE_3, 0)
APP_EXT_SOURCE_1_MINUS_2 = coalesce(EXT_SOURCE_1, 0) - coalesce(EXT_SOURCE_2, 0)
APP_EXT_SOURCE_STD = sqrt(greatest(0, (pow(coalesce(EXT_SOURCE_1, 0), 2) + pow(coalesce(EXT_SOURCE_2, 0), 2) + pow(coalesce(EXT_SOURCE_3, 0), 2)) / 3 - pow((coalesce(EXT_SOURCE_1, 0) + coalesce(EXT_SOURCE_2, 0) + coalesce(EXT_SOURCE_3, 0)) / 3, 2)))
APP_EXT_SOURCE_WEIGHTED_MEAN = coalesce(EXT_SOURCE_1, 0) * 0.15 + coalesce(EXT_SOURCE_2, 0) * 0.45 + coalesce(EXT_SOURCE_3, 0) * 0.4
APP_EXT_SOURCE_COUNT = cast(EXT_SOURCE_1 IS NOT NULL as int) + cast(EXT_SOURCE_2 IS NOT NULL as int) + cast(EXT_SOURCE_3 IS NOT NULL as int)
APP_EXT_SOURCE_2_SQ = pow(coalesce(EXT_SOURCE_2, 0), 2)
APP_EXT_SOURCE_3_SQ = pow(coalesce(EXT_SOURCE_3, 0), 2)
APP_EXT2_x_AGE = coalesce(EXT_SOURCE_2, 0) * (DAYS_BIRTH / -365.25)
APP_EXT3_x_AGE = coalesce(EXT_SOURCE_3, 0) * (DAYS_BIRTH / -365.25)
APP_EXT2_PER_CREDIT = coalesce(EXT_SOURCE_2, 0) * 1000000.0 / nullif(AMT_CREDIT + 1, 0)
APP_DOCUMENT_COUNT = coalesce(FLAG_DOCUMENT_2, 0) + coalesce(FLAG_DOCUMENT_3, 0) + coalesce(FLAG_DOCUMENT_4, 0) + coalesce(FLAG_DOCUMENT_5, 0) + coalesce(FLAG_DOCUMENT_6, 0) + coalesce(FLAG_DOCUMENT_7, 0) + coalesce(FLAG_DOCUMENT_8, 0) + coalesce(FLAG_DOCUMENT_9, 0) + coalesce(FLAG_DOCUMENT_10, 0) + coalesce(FLAG_DOCUMENT_11, 0) + coalesce(FLAG_DOCUMENT_12, 0) + coalesce(FLAG_DOCUMENT_13, 0) + coalesce(FLAG_DOCUMENT_14, 0) + coalesce(FLAG_DOCUMENT_15, 0) + coalesce(FLAG_DOCUMENT_16, 0) + coalesce(FLAG_DOCUMENT_17, 0) + coalesce(FLAG_DOCUMENT_18, 0) + coalesce(FLAG_DOCUMENT_19, 0) + coalesce(FLAG_DOCUMENT_20, 0) + coalesce(FLAG_DOCUMENT_21, 0)
APP_CONTACT_REACHABILITY = coalesce(FLAG_CONT_MOBILE, 0) + coalesce(FLAG_EMAIL, 0) + coalesce(FLAG_PHONE, 0) + coalesce(FLAG_WORK_PHONE, 0)
APP_ADDRESS_MISMATCH_SCORE = coalesce(REG_REGION_NOT_LIVE_REGION, 0) + coalesce(REG_REGION_NOT_WORK_REGION, 0) + coalesce(LIVE_REGION_NOT_WORK_REGION, 0) + coalesce(REG_CITY_NOT_LIVE_CITY, 0) + coalesce(REG_CITY_NOT_WORK_CITY, 0) + coalesce(LIVE_CITY_NOT_WORK_CITY, 0)
APP_SOCIAL_DEF_30_RATE = coalesce(DEF_30_CNT_SOCIAL_CIRCLE, 0) / nullif(coalesce(OBS_30_CNT_SOCIAL_CIRCLE, 0) + 1, 0)
APP_SOCIAL_DEF_60_RATE = coalesce(DEF_60_CNT_SOCIAL_CIRCLE, 0) / nullif(coalesce(OBS_60_CNT_SOCIAL_CIRCLE, 0) + 1, 0)
APP_RECENT_INQUIRIES_WEIGHTED = coalesce(AMT_REQ_CREDIT_BUREAU_QRT, 0) + coalesce(AMT_REQ_CREDIT_BUREAU_MON, 0) * 3
APP_TOTAL_INQUIRIES = coalesce(AMT_REQ_CREDIT_BUREAU_HOUR, 0) + coalesce(AMT_REQ_CREDIT_BUREAU_DAY, 0) + coalesce(AMT_REQ_CREDIT_BUREAU_WEEK, 0) + coalesce(AMT_REQ_CREDIT_BUREAU_MON, 0) + coalesce(AMT_REQ_CREDIT_BUREAU_QRT, 0) + coalesce(AMT_REQ_CREDIT_BUREAU_YEAR, 0)
APP_REGISTRATION_TO_AGE_RATIO = DAYS_REGISTRATION / nullif(DAYS_BIRTH, 0)
APP_ID_PUBLISH_TO_AGE_RATIO = DAYS_ID_PUBLISH / nullif(DAYS_BIRTH, 0)
APP_PHONE_CHANGE_TO_AGE_RATIO = DAYS_LAST_PHONE_CHANGE / nullif(DAYS_BIRTH, 0)
APP_REGISTRATION_YEARS = DAYS_REGISTRATION / -365.25
APP_ID_PUBLISH_YEARS = DAYS_ID_PUBLISH / -365.25
APP_PHONE_CHANGE_YEARS = DAYS_LAST_PHONE_CHANGE / -365.25
APP_BUILDING_INFO_NULL_COUNT = cast(APARTMENTS_AVG IS NULL as int) + cast(BASEMENTAREA_AVG IS NULL as int) + cast(YEARS_BEGINEXPLUATATION_AVG IS NULL as int) + cast(YEARS_BUILD_AVG IS NULL as int) + cast(COMMONAREA_AVG IS NULL as int) + cast(ELEVATORS_AVG IS NULL as int) + cast(ENTRANCES_AVG IS NULL as int) + cast(FLOORSMAX_AVG IS NULL as int) + cast(FLOORSMIN_AVG IS NULL as int) + cast(LANDAREA_AVG IS NULL as int) + cast(LIVINGAPARTMENTS_AVG IS NULL as int) + cast(LIVINGAREA_AVG IS NULL as int) + cast(NONLIVINGAPARTMENTS_AVG IS NULL as int) + cast(NONLIVINGAREA_AVG IS NULL as int)
"""

BALANCE = """
BB_MONTHS_COUNT = count(*)
BB_STATUS_0_COUNT = coalesce(count_if(STATUS = '0'), 0)
BB_STATUS_1_COUNT = coalesce(count_if(STATUS = '1'), 0)
BB_STATUS_2_COUNT = coalesce(count_if(STATUS = '2'), 0)
BB_STATUS_3_COUNT = coalesce(count_if(STATUS = '3'), 0)
BB_STATUS_4_COUNT = coalesce(count_if(STATUS = '4'), 0)
BB_STATUS_5_COUNT = coalesce(count_if(STATUS = '5'), 0)
BB_STATUS_C_COUNT = coalesce(count_if(STATUS = 'C'), 0)
BB_STATUS_X_COUNT = coalesce(count_if(STATUS = 'X'), 0)
BB_DPD_MONTHS = coalesce(count_if(STATUS IN ('1','2','3','4','5')), 0)
BB_MONTHS_BALANCE_MIN = min(MONTHS_BALANCE)
BB_MONTHS_BALANCE_MAX = max(MONTHS_BALANCE)
BB_RECENT_6M_DPD = coalesce(count_if(MONTHS_BALANCE >= -6 AND STATUS IN ('1','2','3','4','5')), 0)
BB_RECENT_6M_COUNT = coalesce(count_if(MONTHS_BALANCE >= -6), 0)
"""

BALANCE_RATIOS = """
BB_DPD_RATE = BB_DPD_MONTHS / nullif(BB_MONTHS_COUNT + 1, 0)
BB_RECENT_6M_DPD_RATE = BB_RECENT_6M_DPD / nullif(BB_RECENT_6M_COUNT + 1, 0)
"""

BUREAU = """
BUR_COUNT = count(*)
BUR_CONSUMER_COUNT = coalesce(count_if(CREDIT_TYPE = 'Consumer credit'), 0)
BUR_CREDIT_CARD_COUNT = coalesce(count_if(CREDIT_TYPE = 'Credit card'), 0)
BUR_MORTGAGE_COUNT = coalesce(count_if(CREDIT_TYPE = 'Mortgage'), 0)
BUR_CAR_LOAN_COUNT = coalesce(count_if(CREDIT_TYPE = 'Car loan'), 0)
BUR_MICROLOAN_COUNT = coalesce(count_if(CREDIT_TYPE = 'Microloan'), 0)
BUR_ACTIVE_COUNT = coalesce(count_if(CREDIT_ACTIVE = 'Active'), 0)
BUR_CLOSED_COUNT = coalesce(count_if(CREDIT_ACTIVE = 'Closed'), 0)
BUR_BAD_DEBT_COUNT = coalesce(count_if(CREDIT_ACTIVE = 'Bad debt'), 0)
BUR_AMT_CREDIT_MEAN = avg(AMT_CREDIT_SUM)
BUR_AMT_CREDIT_TOTAL = coalesce(sum(AMT_CREDIT_SUM), 0)
BUR_AMT_CREDIT_MAX = max(AMT_CREDIT_SUM)
BUR_DEBT_MEAN = avg(AMT_CREDIT_SUM_DEBT)
BUR_DEBT_TOTAL = coalesce(sum(AMT_CREDIT_SUM_DEBT), 0)
BUR_DEBT_MAX = max(AMT_CREDIT_SUM_DEBT)
BUR_OVERDUE_TOTAL = coalesce(sum(AMT_CREDIT_SUM_OVERDUE), 0)
BUR_OVERDUE_MAX = max(AMT_CREDIT_SUM_OVERDUE)
BUR_OVERDUE_COUNT = coalesce(count_if(AMT_CREDIT_SUM_OVERDUE > 0), 0)
BUR_CREDIT_LIMIT_MEAN = avg(AMT_CREDIT_SUM_LIMIT)
BUR_MAX_OVERDUE_EVER = max(AMT_CREDIT_MAX_OVERDUE)
BUR_MAX_OVERDUE_MEAN = avg(AMT_CREDIT_MAX_OVERDUE)
BUR_MOST_RECENT_CREDIT_DAYS = max(DAYS_CREDIT)
BUR_OLDEST_CREDIT_DAYS = min(DAYS_CREDIT)
BUR_LATEST_ENDDATE = max(DAYS_CREDIT_ENDDATE)
BUR_MOST_RECENT_UPDATE = max(DAYS_CREDIT_UPDATE)
BUR_INQUIRIES_LAST_YEAR = coalesce(count_if(DAYS_CREDIT > -365), 0)
BUR_ANNUITY_TOTAL = coalesce(sum(AMT_ANNUITY), 0)
BUR_ANNUITY_MEAN = avg(AMT_ANNUITY)
BUR_BB_DPD_MONTHS_TOTAL = coalesce(sum(BB_DPD_MONTHS), 0)
BUR_BB_DPD_RATE_MEAN = avg(BB_DPD_RATE)
BUR_BB_MONTHS_TOTAL = coalesce(sum(BB_MONTHS_COUNT), 0)
BUR_BB_STATUS_C_TOTAL = coalesce(sum(BB_STATUS_C_COUNT), 0)
BUR_BB_STATUS_X_TOTAL = coalesce(sum(BB_STATUS_X_COUNT), 0)
BUR_BB_RECENT_6M_DPD_TOTAL = coalesce(sum(BB_RECENT_6M_DPD), 0)
BUR_BB_RECENT_6M_DPD_RATE_MEAN = avg(BB_RECENT_6M_DPD_RATE)
"""

BUREAU_ACTIVE = """
BUR_ACTIVE_CREDIT_TOTAL = coalesce(sum(AMT_CREDIT_SUM), 0)
BUR_ACTIVE_DEBT_TOTAL = coalesce(sum(AMT_CREDIT_SUM_DEBT), 0)
BUR_ACTIVE_OVERDUE_TOTAL = coalesce(sum(AMT_CREDIT_SUM_OVERDUE), 0)
BUR_ACTIVE_ANNUITY_TOTAL = coalesce(sum(AMT_ANNUITY), 0)
"""

BUREAU_1Y = """
BUR_RECENT_1Y_COUNT = count(*)
BUR_RECENT_1Y_CREDIT_MEAN = avg(AMT_CREDIT_SUM)
BUR_RECENT_1Y_OVERDUE = coalesce(sum(AMT_CREDIT_SUM_OVERDUE), 0)
BUR_RECENT_1Y_ACTIVE = coalesce(count_if(CREDIT_ACTIVE = 'Active'), 0)
"""

BUREAU_2Y = """
BUR_RECENT_2Y_COUNT = count(*)
BUR_RECENT_2Y_DEBT = coalesce(sum(AMT_CREDIT_SUM_DEBT), 0)
BUR_RECENT_2Y_OVERDUE_COUNT = coalesce(count_if(AMT_CREDIT_SUM_OVERDUE > 0), 0)
"""

BUREAU_RATIOS = """
BUR_ACTIVE_RATIO = BUR_ACTIVE_COUNT / nullif(BUR_COUNT + 1, 0)
BUR_DEBT_TO_CREDIT_RATIO = BUR_DEBT_TOTAL / nullif(BUR_AMT_CREDIT_TOTAL + 1, 0)
BUR_OVERDUE_RATE = BUR_OVERDUE_COUNT / nullif(BUR_COUNT + 1, 0)
BUR_CREDIT_HISTORY_LENGTH = BUR_MOST_RECENT_CREDIT_DAYS - BUR_OLDEST_CREDIT_DAYS
BUR_ACTIVE_DEBT_TO_CREDIT_RATIO = coalesce(BUR_ACTIVE_DEBT_TOTAL, 0) / nullif(coalesce(BUR_ACTIVE_CREDIT_TOTAL, 0) + 1, 0)
BUR_CREDIT_TYPE_DIVERSITY = cast(BUR_CONSUMER_COUNT > 0 as int) + cast(BUR_CREDIT_CARD_COUNT > 0 as int) + cast(BUR_MORTGAGE_COUNT > 0 as int) + cast(BUR_CAR_LOAN_COUNT > 0 as int) + cast(BUR_MICROLOAN_COUNT > 0 as int)
"""

PREVIOUS = """
PREV_COUNT = count(*)
PREV_APPROVED_COUNT = coalesce(count_if(NAME_CONTRACT_STATUS = 'Approved'), 0)
PREV_REFUSED_COUNT = coalesce(count_if(NAME_CONTRACT_STATUS = 'Refused'), 0)
PREV_CANCELED_COUNT = coalesce(count_if(NAME_CONTRACT_STATUS = 'Canceled'), 0)
PREV_AMT_APPLICATION_MEAN = avg(AMT_APPLICATION)
PREV_AMT_APPLICATION_MAX = max(AMT_APPLICATION)
PREV_AMT_APPLICATION_TOTAL = coalesce(sum(AMT_APPLICATION), 0)
PREV_AMT_CREDIT_MEAN = avg(AMT_CREDIT)
PREV_AMT_CREDIT_TOTAL = coalesce(sum(AMT_CREDIT), 0)
PREV_APP_CREDIT_DIFF_MEAN = avg(AMT_APPLICATION - AMT_CREDIT)
PREV_ANNUITY_MEAN = avg(AMT_ANNUITY)
PREV_ANNUITY_MAX = max(AMT_ANNUITY)
PREV_DOWN_PAYMENT_MEAN = avg(AMT_DOWN_PAYMENT)
PREV_DOWN_PAYMENT_MAX = max(AMT_DOWN_PAYMENT)
PREV_MOST_RECENT_DECISION = max(DAYS_DECISION)
PREV_OLDEST_DECISION = min(DAYS_DECISION)
PREV_DAYS_FIRST_DRAWING_MEAN = avg(DAYS_FIRST_DRAWING)
PREV_DAYS_FIRST_DUE_MEAN = avg(DAYS_FIRST_DUE)
PREV_DAYS_LAST_DUE_MEAN = avg(DAYS_LAST_DUE_1ST_VERSION)
PREV_DAYS_TERMINATION_MEAN = avg(DAYS_TERMINATION)
PREV_CASH_LOAN_COUNT = coalesce(count_if(NAME_CONTRACT_TYPE = 'Cash loans'), 0)
PREV_REVOLVING_COUNT = coalesce(count_if(NAME_CONTRACT_TYPE = 'Revolving loans'), 0)
PREV_PRODUCT_VARIETY = count(DISTINCT PRODUCT_COMBINATION) + max(cast(PRODUCT_COMBINATION IS NULL as int))
PREV_HIGH_YIELD_COUNT = coalesce(count_if(NAME_YIELD_GROUP = 'high'), 0)
PREV_LOW_YIELD_COUNT = coalesce(count_if(NAME_YIELD_GROUP = 'low_normal'), 0)
PREV_CHANNEL_VARIETY = count(DISTINCT CHANNEL_TYPE) + max(cast(CHANNEL_TYPE IS NULL as int))
PREV_WEEKEND_APP_COUNT = coalesce(count_if(WEEKDAY_APPR_PROCESS_START = 'SATURDAY'), 0)
PREV_SUNDAY_APP_COUNT = coalesce(count_if(WEEKDAY_APPR_PROCESS_START = 'SUNDAY'), 0)
PREV_INSURED_COUNT = coalesce(count_if(NFLAG_INSURED_ON_APPROVAL = 1), 0)
PREV_PAYMENT_TERM_MEAN = avg(CNT_PAYMENT)
PREV_PAYMENT_TERM_MAX = max(CNT_PAYMENT)
"""

PREVIOUS_APPROVED = """
PREV_APPROVED_CREDIT_MEAN = avg(AMT_CREDIT)
PREV_APPROVED_CREDIT_MAX = max(AMT_CREDIT)
PREV_APPROVED_ANNUITY_MEAN = avg(AMT_ANNUITY)
PREV_LAST_APPROVED_DAYS = max(DAYS_DECISION)
PREV_APPROVED_DOWN_PAYMENT_MEAN = avg(AMT_DOWN_PAYMENT)
"""

PREVIOUS_REFUSED = """
PREV_REFUSED_AMT_MEAN = avg(AMT_APPLICATION)
PREV_LAST_REFUSED_DAYS = max(DAYS_DECISION)
"""

PREVIOUS_1Y = """
PREV_RECENT_1Y_COUNT = count(*)
PREV_RECENT_1Y_APPROVED = coalesce(count_if(NAME_CONTRACT_STATUS = 'Approved'), 0)
PREV_RECENT_1Y_REFUSED = coalesce(count_if(NAME_CONTRACT_STATUS = 'Refused'), 0)
"""

PREVIOUS_RATIOS = """
PREV_APPROVAL_RATE = PREV_APPROVED_COUNT / nullif(PREV_COUNT + 1, 0)
PREV_REFUSAL_RATE = PREV_REFUSED_COUNT / nullif(PREV_COUNT + 1, 0)
PREV_CASH_LOAN_RATIO = PREV_CASH_LOAN_COUNT / nullif(PREV_COUNT + 1, 0)
PREV_HISTORY_SPAN = PREV_MOST_RECENT_DECISION - PREV_OLDEST_DECISION
PREV_RECENT_1Y_APPROVAL_RATE = coalesce(PREV_RECENT_1Y_APPROVED, 0) / nullif(coalesce(PREV_RECENT_1Y_COUNT, 0) + 1, 0)
"""

INSTALMENT_ROWS = """
INS_DAYS_DIFF = DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT
INS_PAYMENT_RATIO = AMT_PAYMENT / nullif(AMT_INSTALMENT + 1, 0)
INS_UNDERPAYMENT = AMT_INSTALMENT - AMT_PAYMENT
"""

INSTALMENTS = """
INS_COUNT = count(*)
INS_NUM_PREV_LOANS = count(DISTINCT SK_ID_PREV) + max(cast(SK_ID_PREV IS NULL as int))
INS_DAYS_DIFF_MEAN = avg(INS_DAYS_DIFF)
INS_DAYS_DIFF_MAX = max(INS_DAYS_DIFF)
INS_DAYS_DIFF_STD = stddev_samp(INS_DAYS_DIFF)
INS_LATE_COUNT = coalesce(count_if(INS_DAYS_DIFF > 0), 0)
INS_LATE_7DAYS_COUNT = coalesce(count_if(INS_DAYS_DIFF > 7), 0)
INS_LATE_30DAYS_COUNT = coalesce(count_if(INS_DAYS_DIFF > 30), 0)
INS_EARLY_COUNT = coalesce(count_if(INS_DAYS_DIFF < 0), 0)
INS_VERY_EARLY_COUNT = coalesce(count_if(INS_DAYS_DIFF < -15), 0)
INS_PAYMENT_RATIO_MEAN = avg(INS_PAYMENT_RATIO)
INS_PAYMENT_RATIO_MIN = min(INS_PAYMENT_RATIO)
INS_PAYMENT_RATIO_STD = stddev_samp(INS_PAYMENT_RATIO)
INS_UNDERPAYMENT_COUNT = coalesce(count_if(INS_UNDERPAYMENT > 0), 0)
INS_UNDERPAYMENT_MEAN = avg(INS_UNDERPAYMENT) FILTER (WHERE INS_UNDERPAYMENT > 0)
INS_UNDERPAYMENT_MAX = max(INS_UNDERPAYMENT) FILTER (WHERE INS_UNDERPAYMENT > 0)
INS_TOTAL_EXPECTED = coalesce(sum(AMT_INSTALMENT), 0)
INS_TOTAL_PAID = coalesce(sum(AMT_PAYMENT), 0)
INS_MAX_VERSION = max(NUM_INSTALMENT_VERSION)
INS_VERSION_VARIETY = count(DISTINCT NUM_INSTALMENT_VERSION) + max(cast(NUM_INSTALMENT_VERSION IS NULL as int))
"""

INSTALMENTS_LAST = """
INS_RECENT_12_DAYS_DIFF_MEAN = avg(INS_DAYS_DIFF) FILTER (WHERE rn <= 12)
INS_RECENT_12_DAYS_DIFF_STD = stddev_samp(INS_DAYS_DIFF) FILTER (WHERE rn <= 12)
INS_RECENT_12_LATE_COUNT = coalesce(count_if(INS_DAYS_DIFF > 0) FILTER (WHERE rn <= 12), 0)
INS_RECENT_12_LATE_30_COUNT = coalesce(count_if(INS_DAYS_DIFF > 30) FILTER (WHERE rn <= 12), 0)
INS_RECENT_12_PAYMENT_RATIO = avg(INS_PAYMENT_RATIO) FILTER (WHERE rn <= 12)
INS_RECENT_12_PAYMENT_RATIO_MIN = min(INS_PAYMENT_RATIO) FILTER (WHERE rn <= 12)
INS_LAST_DAYS_DIFF = max(INS_DAYS_DIFF) FILTER (WHERE rn = 1)
INS_LAST_PAYMENT_RATIO = max(INS_PAYMENT_RATIO) FILTER (WHERE rn = 1)
"""

INSTALMENT_RATIOS = """
INS_LATE_RATE = INS_LATE_COUNT / nullif(INS_COUNT + 1, 0)
INS_OVERALL_PAYMENT_RATIO = INS_TOTAL_PAID / nullif(INS_TOTAL_EXPECTED + 1, 0)
INS_AVG_PER_LOAN = INS_COUNT / nullif(INS_NUM_PREV_LOANS + 1, 0)
INS_RECENT_12_LATE_RATE = INS_RECENT_12_LATE_COUNT / 12.0
"""

POS = """
POS_COUNT = count(*)
POS_NUM_LOANS = count(DISTINCT SK_ID_PREV) + max(cast(SK_ID_PREV IS NULL as int))
POS_DPD_MEAN = avg(SK_DPD)
POS_DPD_MAX = max(SK_DPD)
POS_DPD_SUM = coalesce(sum(SK_DPD), 0)
POS_DPD_MONTHS_COUNT = coalesce(count_if(SK_DPD > 0), 0)
POS_DPD_DEF_MEAN = avg(SK_DPD_DEF)
POS_DPD_DEF_MAX = max(SK_DPD_DEF)
POS_DPD_DEF_COUNT = coalesce(count_if(SK_DPD_DEF > 0), 0)
POS_ACTIVE_MONTHS = coalesce(count_if(NAME_CONTRACT_STATUS = 'Active'), 0)
POS_COMPLETED_MONTHS = coalesce(count_if(NAME_CONTRACT_STATUS = 'Completed'), 0)
POS_SIGNED_MONTHS = coalesce(count_if(NAME_CONTRACT_STATUS = 'Signed'), 0)
POS_MAX_INSTALMENTS = max(CNT_INSTALMENT)
POS_REMAINING_INSTALMENTS_MEAN = avg(CNT_INSTALMENT_FUTURE)
POS_REMAINING_INSTALMENTS_MAX = max(CNT_INSTALMENT_FUTURE)
POS_MONTHS_BALANCE_MIN = min(MONTHS_BALANCE)
"""

POS_6M = """
POS_RECENT_6M_DPD_MAX = max(SK_DPD)
POS_RECENT_6M_DPD_MEAN = avg(SK_DPD)
POS_RECENT_6M_DPD_COUNT = coalesce(count_if(SK_DPD > 0), 0)
POS_RECENT_6M_ACTIVE = coalesce(count_if(NAME_CONTRACT_STATUS = 'Active'), 0)
"""

POS_12M = """
POS_RECENT_12M_DPD_MAX = max(SK_DPD)
POS_RECENT_12M_DPD_COUNT = coalesce(count_if(SK_DPD > 0), 0)
POS_RECENT_12M_DPD_DEF_COUNT = coalesce(count_if(SK_DPD_DEF > 0), 0)
"""

POS_RATIOS = """
POS_DPD_RATE = POS_DPD_MONTHS_COUNT / nullif(POS_COUNT + 1, 0)
POS_COMPLETION_RATE = POS_COMPLETED_MONTHS / nullif(POS_COUNT + 1, 0)
POS_AVG_MONTHS_PER_LOAN = POS_COUNT / nullif(POS_NUM_LOANS + 1, 0)
POS_RECENT_6M_DPD_RATE = coalesce(POS_RECENT_6M_DPD_COUNT, 0) / 6.0
"""

CARD_ROWS = """
CC_UTILIZATION = AMT_BALANCE / nullif(AMT_CREDIT_LIMIT_ACTUAL + 1, 0)
CC_PAYMENT_TO_MIN_RATIO = AMT_PAYMENT_CURRENT / nullif(AMT_INST_MIN_REGULARITY + 1, 0)
CC_DRAWING_RATIO = AMT_DRAWINGS_CURRENT / nullif(AMT_CREDIT_LIMIT_ACTUAL + 1, 0)
"""

CARD = """
CC_COUNT = count(*)
CC_NUM_CARDS = count(DISTINCT SK_ID_PREV) + max(cast(SK_ID_PREV IS NULL as int))
CC_UTILIZATION_MEAN = avg(CC_UTILIZATION)
CC_UTILIZATION_MAX = max(CC_UTILIZATION)
CC_UTILIZATION_STD = stddev_samp(CC_UTILIZATION)
CC_HIGH_UTIL_MONTHS = coalesce(count_if(CC_UTILIZATION > 0.9), 0)
CC_BALANCE_MEAN = avg(AMT_BALANCE)
CC_BALANCE_MAX = max(AMT_BALANCE)
CC_PAYMENT_TO_MIN_MEAN = avg(CC_PAYMENT_TO_MIN_RATIO)
CC_PAYMENT_TO_MIN_MIN = min(CC_PAYMENT_TO_MIN_RATIO)
CC_MIN_PAYMENT_MONTHS = coalesce(count_if(CC_PAYMENT_TO_MIN_RATIO BETWEEN 0.95 AND 1.05), 0)
CC_DRAWINGS_MEAN = avg(AMT_DRAWINGS_CURRENT)
CC_DRAWINGS_MAX = max(AMT_DRAWINGS_CURRENT)
CC_DRAWINGS_TOTAL = coalesce(sum(AMT_DRAWINGS_CURRENT), 0)
CC_DRAWING_RATIO_MEAN = avg(CC_DRAWING_RATIO)
CC_ATM_DRAWINGS_TOTAL = coalesce(sum(AMT_DRAWINGS_ATM_CURRENT), 0)
CC_ATM_DRAWINGS_MEAN = avg(AMT_DRAWINGS_ATM_CURRENT)
CC_ATM_DRAWINGS_COUNT = coalesce(sum(CNT_DRAWINGS_ATM_CURRENT), 0)
CC_POS_DRAWINGS_TOTAL = coalesce(sum(AMT_DRAWINGS_POS_CURRENT), 0)
CC_DPD_MEAN = avg(SK_DPD)
CC_DPD_MAX = max(SK_DPD)
CC_DPD_MONTHS = coalesce(count_if(SK_DPD > 0), 0)
CC_DPD_DEF_MAX = max(SK_DPD_DEF)
CC_CREDIT_LIMIT_MAX = max(AMT_CREDIT_LIMIT_ACTUAL)
CC_CREDIT_LIMIT_MEAN = avg(AMT_CREDIT_LIMIT_ACTUAL)
CC_RECEIVABLE_MEAN = avg(AMT_RECEIVABLE_PRINCIPAL)
CC_TOTAL_RECEIVABLE_MEAN = avg(AMT_TOTAL_RECEIVABLE)
CC_MONTHS_BALANCE_MIN = min(MONTHS_BALANCE)
CC_ACTIVE_MONTHS = coalesce(count_if(NAME_CONTRACT_STATUS = 'Active'), 0)
"""

CARD_3M = """
CC_RECENT_3M_UTIL_MEAN = avg(CC_UTILIZATION)
CC_RECENT_3M_BALANCE_MEAN = avg(AMT_BALANCE)
CC_RECENT_3M_DPD_MAX = max(SK_DPD)
CC_RECENT_3M_PAY_MIN_RATIO = avg(CC_PAYMENT_TO_MIN_RATIO)
"""

CARD_12M = """
CC_RECENT_12M_UTIL_MEAN = avg(CC_UTILIZATION)
CC_RECENT_12M_HIGH_UTIL_MONTHS = coalesce(count_if(CC_UTILIZATION > 0.9), 0)
CC_RECENT_12M_DPD_COUNT = coalesce(count_if(SK_DPD > 0), 0)
CC_RECENT_12M_ATM_TOTAL = coalesce(sum(AMT_DRAWINGS_ATM_CURRENT), 0)
"""

CARD_RATIOS = """
CC_DPD_RATE = CC_DPD_MONTHS / nullif(CC_COUNT + 1, 0)
CC_ATM_DRAWING_SHARE = CC_ATM_DRAWINGS_TOTAL / nullif(CC_DRAWINGS_TOTAL + 1, 0)
CC_HIGH_UTIL_RATE = CC_HIGH_UTIL_MONTHS / nullif(CC_COUNT + 1, 0)
CC_AVG_MONTHS_PER_CARD = CC_COUNT / nullif(CC_NUM_CARDS + 1, 0)
CC_UTIL_TREND_3M = coalesce(CC_RECENT_3M_UTIL_MEAN, 0) - coalesce(CC_UTILIZATION_MEAN, 0)
CC_UTIL_TREND_12M = coalesce(CC_RECENT_12M_UTIL_MEAN, 0) - coalesce(CC_UTILIZATION_MEAN, 0)
"""

H4_BUREAU = """
H4_BUR_PROLONG_TOTAL = coalesce(sum(CNT_CREDIT_PROLONG), 0)
H4_BUR_PROLONG_MAX = max(CNT_CREDIT_PROLONG)
H4_BUR_PROLONG_COUNT = coalesce(count_if(CNT_CREDIT_PROLONG > 0), 0)
H4_BUR_CURRENT_OVERDUE_MAX = max(CREDIT_DAY_OVERDUE)
H4_BUR_CURRENT_OVERDUE_SUM = coalesce(sum(CREDIT_DAY_OVERDUE), 0)
"""

H4_PREVIOUS = """
H4_PREV_INTEREST_RATE_MEAN = avg(RATE_INTEREST_PRIMARY)
H4_PREV_INTEREST_RATE_MAX = max(RATE_INTEREST_PRIMARY)
H4_PREV_REPEATER_RATE = avg(cast(NAME_CLIENT_TYPE = 'Repeater' as double))
H4_PREV_NEW_CLIENT_RATE = avg(cast(NAME_CLIENT_TYPE = 'New' as double))
H4_PREV_REJECT_HC_COUNT = coalesce(count_if(CODE_REJECT_REASON = 'HC'), 0)
H4_PREV_REJECT_SCOFR_COUNT = coalesce(count_if(CODE_REJECT_REASON = 'SCOFR'), 0)
H4_PREV_LOAN_PURPOSE_DIVERSITY = count(DISTINCT NAME_CASH_LOAN_PURPOSE) + max(cast(NAME_CASH_LOAN_PURPOSE IS NULL as int))
"""

CROSS = """
CROSS_EXISTING_DEBT_TO_NEW_CREDIT = coalesce(BUR_DEBT_TOTAL, 0) / nullif(AMT_CREDIT + 1, 0)
CROSS_TOTAL_CREDIT_TO_INCOME = (coalesce(BUR_AMT_CREDIT_TOTAL, 0) + AMT_CREDIT) / nullif(AMT_INCOME_TOTAL + 1, 0)
CROSS_TOTAL_ANNUITY_TO_INCOME = (coalesce(BUR_ACTIVE_ANNUITY_TOTAL, 0) + coalesce(AMT_ANNUITY, 0)) / nullif(AMT_INCOME_TOTAL + 1, 0)
CROSS_REFUSAL_RATE_x_CREDIT = coalesce(PREV_REFUSAL_RATE, 0) * AMT_CREDIT
CROSS_EXT2_x_LATE_RATE = coalesce(EXT_SOURCE_2, 0) * coalesce(INS_LATE_RATE, 0)
CROSS_FIRST_TIME_APPLICANT = cast(PREV_COUNT IS NULL as int)
CROSS_NO_BUREAU_HISTORY = cast(BUR_COUNT IS NULL as int)
CROSS_CREDIT_VS_PREV_APPROVED = AMT_CREDIT / nullif(coalesce(PREV_APPROVED_CREDIT_MEAN, 0) + 1, 0)
CROSS_COMBINED_DPD_SCORE = coalesce(BUR_BB_DPD_RATE_MEAN, 0) + coalesce(POS_DPD_RATE, 0) + coalesce(CC_DPD_RATE, 0) + coalesce(INS_LATE_RATE, 0)
CROSS_EXT3_ADJUSTED_BY_DPD = coalesce(EXT_SOURCE_3, 0) * (1 - coalesce(BUR_BB_DPD_RATE_MEAN, 0))
CROSS_EXT2_ADJUSTED_BY_OVERDUE = coalesce(EXT_SOURCE_2, 0) * (1 - coalesce(BUR_OVERDUE_RATE, 0))
CROSS_ACTIVE_DEBT_TO_INCOME = coalesce(BUR_ACTIVE_DEBT_TOTAL, 0) / nullif(AMT_INCOME_TOTAL + 1, 0)
CROSS_CC_UTIL_PER_AGE = coalesce(CC_UTILIZATION_MEAN, 0) / nullif(DAYS_BIRTH / -365.25 + 1, 0)
CROSS_LATE_RATE_x_EMPLOYMENT = coalesce(INS_LATE_RATE, 0) * least(greatest(coalesce(DAYS_EMPLOYED, 0) / -365.25, 0), 50)
CROSS_THIN_FILE_SCORE = cast(BUR_COUNT IS NULL as int) + cast(PREV_COUNT IS NULL as int) + cast(INS_COUNT IS NULL as int) + cast(POS_COUNT IS NULL as int) + cast(CC_COUNT IS NULL as int)
CROSS_RECENT_DPD_SCORE = coalesce(BUR_BB_RECENT_6M_DPD_RATE_MEAN, 0) + coalesce(POS_RECENT_6M_DPD_RATE, 0) + coalesce(INS_RECENT_12_LATE_RATE, 0) + coalesce(CC_RECENT_12M_DPD_COUNT, 0) / 12.0
CROSS_WORSENING_BEHAVIOR_SCORE = coalesce(CC_UTIL_TREND_12M, 0) - coalesce(INS_RECENT_12_PAYMENT_RATIO, 1) + 1
CROSS_EXPERIENCE_x_SCORE = ln(1 + coalesce(PREV_COUNT, 0)) * coalesce(APP_EXT_SOURCE_MEAN, 0)
"""
