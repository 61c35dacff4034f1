import json

import pytest

from lakeatlas.operators import graph, validate
from lakeatlas.operators.edges import pair_many_to_many
from lakeatlas.sources import catalogue, corpus, documents


def files(spark, *contents, path="app/models.py"):
    return spark.createDataFrame([(f"p{i}", path, c) for i, c in enumerate(contents)], "project string, path string, content string")


def rows(df, *columns):
    return sorted(tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.select(*columns).collect())


def test_schema_rb(spark):
    text = """ActiveRecord::Schema[7.0].define(version: 1) do
  create_table "users", force: :cascade do |t|
    t.string "email", limit: 100, default: "x", null: false
    t.decimal "score", precision: 8, scale: 2
    t.references :company, foreign_key: true, null: false
    t.references :owner, polymorphic: true
    t.timestamps
    t.index ["email"], name: "by_email", unique: true
    t.magic "what"
  end
  create_table "tags", id: false do |t|
    t.integer "n"
  end
  add_index "tags", ["n"]
  add_foreign_key "posts", "users"
end
"""
    got = corpus.schema_rb(files(spark, text))
    cols = rows(got["columns"].where("table_name = 'users'"), "pos", "name", "sql_type", "nullable", "primary")
    assert [c[1] for c in cols] == ["id", "email", "score", "company_id", "owner_id", "owner_type", "created_at", "updated_at"]
    assert cols[0] == (1, "id", "bigint", False, True) and cols[1][2:4] == ("string(100)", False) and cols[2][2] == "decimal(8,2)"
    assert rows(got["columns"].where("table_name = 'tags'"), "name") == [("n",)]
    assert set(rows(got["indexes"], "table_name", "name", "unique")) == {
        ("users", "by_email", True),
        ("users", "index_users_on_company_id", False),
        ("users", "index_users_on_owner_type_owner_id", False),
        ("tags", "index_tags_on_n", False),
    }
    assert rows(got["fks"], "table_name", "column_name", "ref_table") == [("posts", "user_id", "users"), ("users", "company_id", "companies")]
    assert sorted(r.message for r in got["warnings"].collect()) == [
        "foreign key, unknown table: posts.user_id -> users",
        "foreign key, unknown target: users.company_id -> companies",
        'unknown statement: t.magic "what"',
    ]
    assert got["edges"].count() == 0


def test_dbml(spark):
    text = """Table users {
  id int [pk, increment]
  "full name" varchar(20) [not null, default: 'a b', unique]
  n decimal
  indexes {
    (id, n) [unique, name: 'two']
  }
  Note: 'people'
}
Table posts {
  user_id int
}
Ref: posts.user_id > users.id
Ref: users.id < posts.user_id
TableGroup g {
  users
}
"""
    got = corpus.dbml(files(spark, text))
    assert rows(got["columns"].where("table_name = 'users'"), "pos", "name", "type", "nullable", "primary", "unique", "increment") == [
        (1, "id", "integer", False, True, False, True),
        (2, "full name", "string", False, False, True, False),
        (3, "n", "decimal", True, False, False, False),
    ]
    assert rows(got["columns"].where("default is not null"), "default") == [("a b",)]
    assert rows(got["refs"], "table_name", "column_name", "ref_table") == [("posts", "user_id", "users")] * 2
    assert rows(got["indexes"], "columns", "unique", "name") == [(("id", "n"), True, "two")]
    assert [r.message for r in got["warnings"].collect()] == ["ignored block"]


def test_mermaid(spark):
    text = 'erDiagram\n    users ||--o{ posts : "author"\n    users ||--|| profiles : has\n    posts }o--o{ tags : ""\n    users {\n        bigint id PK\n        string name\n    }\n'
    got = corpus.mermaid(files(spark, text))
    assert rows(got["edges"], "table_name", "type", "name", "target") == [
        ("posts", "belongs_to", "author", "users"),
        ("posts", "has_and_belongs_to_many", "tags", "tags"),
        ("users", "has_one", "has", "profiles"),
    ]
    assert rows(got["columns"], "pos", "name", "type", "primary") == [(1, "id", "bigint", True), (2, "name", "string", False)]
    assert rows(got["tables"], "table_name") == [("posts",), ("profiles",), ("tags",), ("users",)]


def test_prisma(spark):
    text = """model User {
  id    Int    @id
  email String @unique @map("mail")
  posts Post[]
  @@map("users")
}
model Post {
  id       Int   @id
  authorId Int
  author   User  @relation(fields: [authorId], references: [id])
  tags     Tag[]
  @@index([authorId, id])
}
model Tag {
  id    Int    @id
  posts Post[]
}
"""
    got = corpus.prisma(files(spark, text))
    assert rows(got["edges"], "table_name", "type", "name", "target", "foreign_key") == [("Post", "belongs_to", "author", "users", "authorId")]
    assert ("users", "mail", "string", True) in rows(got["fields"], "table_name", "name", "type", "unique")
    paired = rows(pair_many_to_many(got["list_fields"]), "table_name", "field", "type")
    assert paired == [("Post", "tags", "has_and_belongs_to_many"), ("Tag", "posts", "has_and_belongs_to_many"), ("users", "posts", "has_many")]


def test_rails_models(spark):
    text = """class ApplicationRecord < ActiveRecord::Base
end
class User < ApplicationRecord # a comment
  self.table_name = "people"
  has_many :posts
  belongs_to :company, foreign_key: :firm_id
  belongs_to :owner, polymorphic: true
  has_many :tags, through: :taggings
end
class Admin < User
end
class Helper
end
"""
    got = corpus.rails_models(files(spark, text, path="app/models/user.rb"))
    assert rows(got["edges"], "table_name", "type", "name", "target") == [
        ("people", "belongs_to", "company", "companies"),
        ("people", "belongs_to", "owner", "owner"),
        ("people", "has_many", "posts", "posts"),
        ("people", "has_many", "tags", "tags"),
    ]
    assert rows(graph.models(got["bases"], ["ActiveRecord::Base"]), "src") == [("Admin",), ("ApplicationRecord",), ("User",)]
    assert rows(got["tables"], "cls", "real") == [("Admin", "people"), ("User", "people")]
    assert rows(graph.inheritance_roots(got["bases"], got["tables"].select("schema_id", "cls")), "src", "root") == [("Admin", "User")]


def test_rails_inheritance_and_names(spark):
    one = """module Named
  extend ActiveSupport::Concern
  included { self.table_name = "aaa_projects" }
end
"""
    two = """class BaseRecord < ApplicationRecord
  self.abstract_class = true
end
class Project < BaseRecord
  include Named
  has_many :tasks
end
class Task < BaseRecord
  belongs_to :project
  # self.table_name = "old"
end
class Chore < Task
  belongs_to :worker, class_name: "Person"
end
class Person < ActiveRecord::Base
end
class Widget
  has_many :parts
end
"""
    df = spark.createDataFrame([("p", "app/models/concerns/named.rb", one), ("p", "app/models/all.rb", two)], "project string, path string, content string")
    got = corpus.rails_models(df)
    assert rows(got["tables"], "cls", "real") == [("Chore", "tasks"), ("Person", "people"), ("Project", "aaa_projects"), ("Task", "tasks")]
    assert rows(got["edges"], "table_name", "type", "target", "foreign_key")[:2] == [
        ("aaa_projects", "has_many", "tasks", None),
        ("tasks", "belongs_to", "aaa_projects", "project_id"),
    ]
    assert ("tasks", "belongs_to", "people") in rows(got["edges"], "table_name", "type", "target")
    by_map = spark.createDataFrame([("p", "Person", "staff")], "schema_id string, cls string, table_name string")
    mapped = corpus.rails_models(df, by_map)
    assert ("Person", "staff") in rows(mapped["tables"], "cls", "real") and ("tasks", "staff") in rows(mapped["edges"], "table_name", "target")


def test_schema_rb_says_what_it_leaves_out(spark):
    got = corpus.schema_rb(files(spark, 'create_table "a" do |t|\nend\nadd_index "b", ["x"]\nadd_index "a", ["y"]\nexecute "SELECT 1"\n'))
    assert rows(got["indexes"], "table_name") == [("a",)]
    assert sorted(r.message for r in got["warnings"].collect()) == ["index on unknown table: b", 'unknown statement: execute "SELECT 1"']


def test_django_inheritance(spark):
    blog = """
class Stamped(models.Model):
    created = models.DateTimeField(null=True)
    class Meta:
        abstract = True
class Named(models.Model):
    name = models.CharField(max_length=9)
    created = None
    class Meta:
        abstract = True
class Tag(Stamped):
    pass
class Post(Named, Stamped):
    tag = models.ForeignKey("Tag", on_delete=models.CASCADE, null=True)
    owner = models.ForeignKey(settings.AUTH_USER_MODEL, on_delete=models.CASCADE)
    item = models.ForeignKey("shop.Item", on_delete=models.CASCADE, db_column="item_no")
    thing = GenericForeignKey("kind", "object_id")
class Shown(Post):
    class Meta:
        proxy = True
class Plain:
    x = models.CharField()
"""
    shop = """
class Tag(Stamped):
    code = models.CharField(primary_key=True)
class Item(models.Model):
    parent = models.ForeignKey("self", null=True, on_delete=models.CASCADE)
    tags = models.ManyToManyField(Tag)
    post = models.OneToOneField(Post, on_delete=models.CASCADE)
"""
    df = spark.createDataFrame([("p", "blog/models.py", blog), ("p", "shop/models.py", shop)], "project string, path string, content string")
    got = corpus.django(corpus.python_models(df))
    assert rows(got["tables"], "table_name") == [("blog_post",), ("blog_tag",), ("shop_item",), ("shop_tag",)]
    names = lambda t: [r.name for r in got["columns"].where(f"table_name = '{t}'").orderBy("pos").collect()]
    assert names("blog_post") == ["id", "name", "created", "tag_id", "owner_id", "item_no"]
    assert names("blog_tag") == ["id", "created"] and names("shop_tag") == ["created", "code"]
    assert rows(got["edges"].na.fill(""), "table_name", "type", "name", "target", "foreign_key", "polymorphic") == [
        (
            "blog_post",
            "belongs_to",
            "item",
            "shop_item",
            "item_no",
            False,
        ), ("blog_post", "belongs_to", "tag", "blog_tag", "tag_id", False), ("blog_post", "belongs_to", "thing", "things", "", True),
        ("shop_item", "belongs_to", "parent", "shop_item", "parent_id", False), (
            "shop_item",
            "has_and_belongs_to_many",
            "tags",
            "shop_tag",
            "",
            False,
        ), ("shop_item", "has_one", "post", "blog_post", "post_id", False),
    ]


def test_sqlalchemy_inheritance(spark):
    text = """
Model = declarative_base()
links = Table("post_tags", Model.metadata)
class Base(DeclarativeBase):
    pass
class Stamped:
    created = Column(DateTime, nullable=False)
class Common(Base):
    __abstract__ = True
    id: Mapped[int] = mapped_column(primary_key=True)
class User(Stamped, Common):
    __tablename__ = "users"
    mail = Column("email", String(20))
    posts: Mapped[list["Post"]] = relationship()
class Post(Common):
    user_id: Mapped[Optional[int]] = mapped_column(ForeignKey("public.users.id"))
    user: Mapped["User"] = relationship()
    tags = relationship("Tag", secondary=links)
class Tag(Model):
    __tablename__ = "tags"
    label = Column(Text)
"""
    got = corpus.sqlalchemy(corpus.python_models(files(spark, text)))
    assert rows(got["tables"], "table_name") == [("post",), ("tags",), ("users",)]
    assert [
        (r.name, r.type, r.nullable) for r in got["columns"].where("table_name = 'users'").orderBy("pos").collect()
    ] == [("created", "datetime", False), ("id", "integer", False), ("email", "string", True)]
    assert ("post", "user_id", "integer", True) in rows(
        got["columns"],
        "table_name",
        "name",
        "type",
        "nullable",
    ) and ("tags", "id", "bigint", True) in rows(got["columns"], "table_name", "name", "type", "primary")
    assert rows(got["edges"].na.fill(""), "table_name", "type", "name", "target", "through") == [
        ("post", "belongs_to", "user", "users", ""),
        ("post", "has_and_belongs_to_many", "tags", "tags", "post_tags"),
        ("users", "has_many", "posts", "post", ""),
    ]
    assert [r.message for r in got["warnings"].collect()] == ["line 15: no __tablename__, taken as post"]


def test_inheritance_order(spark):
    bases = spark.createDataFrame(
        [("s", "C", "A", 0), ("s", "C", "B", 1), ("s", "D", "B", 0), ("s", "D", "A", 1), ("s", "E", "C", 0), ("s", "E", "D", 1), ("s", "A", "E", 0)],
        "schema_id string, src string, dst string, pos int",
    )
    fields = spark.createDataFrame([("s", c, c.lower(), 1) for c in "ABCDE"], "schema_id string, cls string, field string, pos int")
    got = {}
    for r in graph.inherited_fields(bases, fields).orderBy("cls", "pos").collect():
        got.setdefault(r.cls, []).append(r.field)

    def walk(c, seen):
        if c in seen:
            return []
        seen.add(c)
        below = [x for _, src, dst, _ in sorted(tuple(r) for r in bases.orderBy("src", "pos").select("schema_id", "src", "dst", "pos").collect()) if src == c for x in [dst]]
        order = [r.dst for r in bases.where(f"src = '{c}'").orderBy("pos").collect()]
        assert set(order) == set(below)
        return [f for b in order for f in walk(b, seen)] + [c.lower()]

    assert got == {c: walk(c, set()) for c in "ABCDE"}
    straight = graph.inherited_fields(bases.where("src <> 'A'"), fields).where("cls IN ('C', 'D')").orderBy("cls", "pos")
    assert [(r.cls, r.field) for r in straight.collect()] == [("C", "a"), ("C", "b"), ("C", "c"), ("D", "b"), ("D", "a"), ("D", "d")]
