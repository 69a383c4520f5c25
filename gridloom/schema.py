"""The tables that a workbook is read into. All coordinates count from 0; ranges are inclusive."""

VALUE = "struct<kind:string,num:double,str:string,bool:boolean,err:string>"
#: kind: text, number, date, bool, error or formula. A later seq overwrites an earlier one.
CELLS = (
    "workbook_id string, sheet_index int, sheet string, seq long, row int, col int, kind string, num double, str string, bool boolean, "
    f"err string, formula string, cached {VALUE}, display string, style_id int"
)
SHEETS = (
    "workbook_id string, sheet_index int, name string, sheet_type string, visible string, freeze_row int, freeze_col int, zoom int, "
    "right_to_left boolean, gridlines boolean, tab_color string, protected boolean, autofilter string"
)
NAMES = "workbook_id string, scope_sheet string, name string, refers_to string"
RANGES = "workbook_id string, sheet_index int, kind string, name string, r0 int, c0 int, r1 int, c1 int, text string, author string"
PARTS = "workbook_id string, part string, size long, compressed long"
#: One row a workbook that was read. Indices that are not given are NULL.
WORKBOOKS = (
    "workbook_id string, format string, title string, subject string, creator string, keywords string, description string, last_modified_by string, company string, created string, "
    "active_sheet int, structure_protected boolean, date1904 boolean, text_truncated boolean"
)
ERRORS = "workbook_id string, error_kind string, message string"
EVALUATED = f"workbook_id string, sheet string, row int, col int, status string, value {VALUE}, reason string"
